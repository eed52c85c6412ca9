"""Imports and exports of files as tables.

Each file is parsed where it lies: one narrow Arrow pass without a shuffle, since parsers need the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsers import READERS, parse, parse_method

_IMPORT = pa.struct([("source", pa.string()), ("specifiers", pa.list_(pa.string())), ("is_relative", pa.bool_()), ("is_dynamic", pa.bool_()), ("line", pa.int32())])
_EXPORT = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
_PARSED = pa.schema([("path", pa.string()), ("language", pa.string()), ("is_support", pa.bool_()), ("parse_method", pa.string()), ("imports", pa.list_(_IMPORT)), ("exports", pa.list_(_EXPORT))])
PARSED = "path string, language string, is_support boolean, parse_method string, imports array<struct<source:string,specifiers:array<string>,is_relative:boolean,is_dynamic:boolean,line:int>>, exports array<struct<name:string,kind:string,line:int>>"


def _nested(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Lists of tuples as lists of structs, a column at a time."""
    offsets = list(accumulate(map(len, rows), initial=0))
    columns = list(zip(*chain.from_iterable(rows))) or [()] * kind.num_fields
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


#: Files whose findings are held as Python objects at a time.
SLICE = 500


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        path, language, support, content = b.columns
        found = [parse(*row) for row in zip(content.to_pylist(), language.to_pylist(), path.to_pylist())]
        method, imports, exports = zip(*found)
        yield pa.RecordBatch.from_arrays([path, language, support, pa.array(method, pa.string()), _nested(imports, _IMPORT), _nested(exports, _EXPORT)], schema=_PARSED)


def parsed(files: DataFrame) -> DataFrame:
    """One row a file with nested imports and exports."""
    return files.select("path", "language", "is_support", "content").mapInArrow(_run, PARSED)


def _methods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        path, language, content = b.columns
        method = [parse_method(*row) for row in zip(content.to_pylist(), language.to_pylist())]
        yield pa.RecordBatch.from_arrays([path, pa.array(method, pa.string())], ["path", "parse_method"])


def methods(files: DataFrame) -> DataFrame:
    """(path, parse_method) of files whose imports and exports aren't asked for."""
    return files.select("path", "language", "content").mapInArrow(_methods, "path string, parse_method string")


def imports(results: DataFrame) -> DataFrame:
    """``imports`` of parsed files: path, language, ord, source, specifiers, is_relative, is_dynamic, line."""
    return results.select("path", "language", F.posexplode("imports").alias("ord", "i")).select("path", "language", "ord", "i.*")


def exports(results: DataFrame) -> DataFrame:
    return results.select("path", F.posexplode("exports").alias("ord", "e")).select("path", "ord", "e.*")


def parsing_stats(results: DataFrame) -> DataFrame:
    """One row: files, ast, regex, percentage of ast (0 without files), and the paths read as ``regex``."""
    n, a = F.count(F.lit(1)), F.count(F.when(F.col("parse_method") == "ast", 1))
    return results.agg(n.alias("files"), a.alias("ast"), (n - a).alias("regex"), F.when(n > 0, F.floor(100 * a / n + 0.5)).otherwise(0).cast("int").alias("ast_percent"), F.array_sort(F.collect_list(F.when(F.col("parse_method") == "regex", F.col("path")))).alias("regex_files"))


def assert_ast(results: DataFrame, languages: tuple[str, ...] = tuple(READERS)) -> None:
    """Fail when files of languages that have a parser weren't understood as a whole."""
    bad = [r.path for r in results.where((F.col("parse_method") != "ast") & F.col("language").isin(*languages)).select("path").orderBy("path").take(20)]
    if bad:
        raise ValueError(f"not understood as a whole: {', '.join(bad)}")
