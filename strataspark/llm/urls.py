"""Operator 6: URL filter over a sorted digest array.

The blocklist (whole URLs, URLs without their query, hosts) is written once: 64-bit xxhash keys in
ascending order, the places of the full strings, and the strings. The forms that
a URL is looked up as and their keys are computed by Spark (its xxhash64). Workers memory-map the files,
probe all forms of a batch with one vectorised binary search, and compare the stored string of every
hit, so that a collision of digests can't block a URL. Lists of more than ``file_entries`` entries
are split by the leading bits of the key, each part a set of files of its own.

A URL is made canonical first: no scheme, user, port or fragment; host in lower case; an empty path is
``/``. It is blocked when the list has, in this order, the canonical URL, the URL without its query, its
host, or a parent domain of its host that has a dot.

Defined results: null and blank URLs are never blocked; repeated rows each get an answer; null, blank and repeated
entries of the list are ignored; an empty list blocks nothing. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, store

FILE_ENTRIES = 1_000_000
#: Domains of gambling, advertising, spam, pharmacy and adult sites; chosen by hand from the host names of the given pages.
LISTED = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def canonical(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^[^@]*@", ""), ":[0-9]*$", ""))
    tail = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(F.length(host) > 0, F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def candidates(url: str) -> Column:
    """What a canonical URL is looked up as, the most specific first: itself, without its query, its host, parent domains with a dot."""
    u = F.col(url)
    path = F.substring_index(u, "?", 1)
    host = F.substring_index(path, "/", 1)
    labels = F.split(host, "[.]")
    none = F.array().cast("array<string>")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(none)
    return F.when(u.isNotNull(), F.concat(F.array(u), F.when(path != u, F.array(path)).otherwise(none), F.array(host), parents))


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of keys: the part of the list that they are in."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _store(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        part = t.column("part")[0].as_py()
        texts = [s.encode() for s in t.column("entry").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in texts])]).astype(np.int64)
        base = f"{path}/{part:06d}"
        files.write(f"{base}.keys", t.column("key").to_numpy().tobytes())
        files.write(f"{base}.ends", ends.tobytes())
        files.write(f"{base}.text", b"".join(texts))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(texts)], pa.int64())], names=["part", "entries"])


def build(entries: DataFrame, file_entries: int = FILE_ENTRIES) -> tuple[str, int, list[int]]:
    """Write the list (first column: canonical entries). Gives the folder, the bits that choose a part, and the parts."""
    spark = entries.sparkSession
    entry = F.col(entries.columns[0]).cast("string")
    unique = store.cut(entries.select(F.trim(entry).alias("entry")).where(F.length("entry") > 0).distinct(), "entries")
    bits = max(0, int(np.ceil(np.log2(max(1, unique.count()) / file_entries))))
    path = store.fresh_path(spark, "urls")
    key = F.xxhash64("entry")
    keyed = unique.select("entry", key.alias("key"), (F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0)).cast("int").alias("part"))
    made = keyed.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("key", "entry").mapInArrow(lambda it: _store(it, path), "part int, entries long")
    parts = sorted(r.part for r in made.collect())
    store.discard(unique)
    return path, bits, parts


class Probe:
    """Looks strings up in the memory-mapped files."""

    def __init__(self, path: str, bits: int, parts: list[int]):
        self.path, self.bits, self.parts = path, bits, set(parts)

    def has(self, strings: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Places of the strings, whose keys are given, that the list has."""
        out: list[int] = []
        part = part_of(keys, self.bits)
        for p in np.unique(part).tolist():
            if p not in self.parts:
                continue
            base = f"{self.path}/{p:06d}"
            sorted_keys, ends = files.array(f"{base}.keys", "int64"), files.array(f"{base}.ends", "int64")
            text = files.array(f"{base}.text", "uint8")
            own = np.flatnonzero(part == p)
            at = np.searchsorted(sorted_keys, keys[own])
            hit = np.flatnonzero((at < len(sorted_keys)) & (sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys[own]))
            for i in hit.tolist():
                k, key, want = int(at[i]), keys[own[i]], strings[int(own[i])].as_py().encode()
                while k < len(sorted_keys) and sorted_keys[k] == key:  # strings that share a digest are neighbours
                    if text[ends[k] : ends[k + 1]].tobytes() == want:
                        out.append(int(own[i]))
                        break
                    k += 1
        return np.array(sorted(out), np.int64)


def filtered(pages: DataFrame, blocklist: DataFrame, id_column: str = "page_id", url_column: str = "url", file_entries: int = FILE_ENTRIES) -> DataFrame:
    """(id, url, blocked, entry): for every URL whether it is blocked and by which entry; no shuffle of the pages."""
    path, bits, parts = build(blocklist, file_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(path, bits, parts)
        for b in batches:
            strings, keys = b.column(2).flatten(), b.column(3).flatten()
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
            hit = probe.has(strings, keys.to_numpy(zero_copy_only=False))
            rows, first = np.unique(row[hit], return_index=True)
            place = np.full(b.num_rows, -1, np.int64)
            place[rows] = hit[first]
            entry = strings.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place >= 0), entry], names=[id_column, url_column, "blocked", "entry"])

    plain = pages.select(F.col(id_column).cast("long").alias(id_column), F.col(url_column).cast("string").alias(url_column), canonical(F.col(url_column)).alias("canonical"))
    plain = plain.select(id_column, url_column, candidates("canonical").alias("forms")).withColumn("keys", F.transform("forms", lambda f: F.xxhash64(f)))
    return plain.mapInArrow(run, f"`{id_column}` long, `{url_column}` string, blocked boolean, entry string")


def bad_urls(pages: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """Blocklist from labelled documents: URLs of pages whose document (the number in the path) is
    of low quality or toxic, and hosts with ``least`` labelled documents or more, all of them bad."""
    url = canonical(F.col("url"))
    numbered = pages.select(url.alias("u"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)").alias("doc"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    seen = numbered.join(marks, "doc").select("u", F.split("u", "/")[0].alias("host"), "bad")
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("b")).where((F.col("n") >= least) & (F.col("n") == F.col("b")))
    return seen.where("bad = 1").select(F.col("u").alias("entry")).union(hosts.select("host"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filtered(pages, bad_urls(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def blocklist(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``LISTED`` domains, which block all their hosts, besides the URLs and hosts of :func:`bad_urls`."""
    return bad_urls(pages, labels).union(pages.sparkSession.createDataFrame([(d,) for d in LISTED], "entry string"))


def op6_urls_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filtered(pages, blocklist(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP6_SQL = """
WITH r AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
h AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')) AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM r),
c AS (SELECT page_id, url, host, CASE WHEN length(host) > 0 THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS u,
             TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS doc FROM h),
m AS (SELECT doc_id AS doc, max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
s AS (SELECT c.u, c.host, m.bad FROM c JOIN m USING (doc)),
l AS (SELECT u AS entry FROM s WHERE bad = 1 UNION SELECT host FROM s GROUP BY host HAVING count(*) >= 2 AND count(*) = sum(bad)),
forms AS (
  SELECT page_id, url, u AS f, 0 AS k FROM c UNION ALL
  SELECT page_id, url, split_part(u, '?', 1), 1 FROM c UNION ALL
  SELECT page_id, url, host, 2 FROM c UNION ALL
  SELECT page_id, url, array_to_string(list_slice(string_split(host, '.'), i, NULL), '.'), 1 + i FROM c, range(2, 12) t(i) WHERE i < len(string_split(host, '.'))),
b AS (SELECT page_id, url, arg_min(f, k) AS entry FROM forms JOIN l ON f = l.entry GROUP BY page_id, url)
SELECT c.page_id, c.url, b.entry IS NOT NULL AS blocked, b.entry FROM c LEFT JOIN b ON c.page_id = b.page_id AND c.url = b.url
"""
