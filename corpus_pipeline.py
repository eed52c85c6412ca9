"""The corpus pipeline: documents go through the stages in order, each written as Parquet and read
again by the next. A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import decontaminate, langid, minhash, mixing, sharding, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents in none of the known languages go.

    Null, empty and letterless texts go, in any other column nulls, repeats and clashing names change nothing; very long texts
    are parsed whole; of equal scores the first language counts, which decides no document's stay; an empty table stays empty.
    """
    return langid.accepted(docs, *langid.training(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates stays, the one of least doc_id (null ids last, then the least
    hash of the text).

    Documents without words (null, empty, punctuation) are no one's duplicates and stay; rows of equal doc_id and text are one
    document, of which the row that is least as JSON stays; very long texts are compared whole; extra columns are carried along.
    """
    return minhash.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: leaked benchmark passages are cut out, with ``n_chars`` following, and mostly leaked documents go.

    Null and empty texts stay as they are, repeated rows each get the same answer, very long texts are read whole, extra columns
    are carried along; an empty benchmark changes nothing.
    """
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents in training order along the curriculum; a source in surplus loses its last documents, a scarce one
    repeats.

    Documents without words (null, empty, blank) have nothing to train on and go. A null source is one of its own; repeated rows
    are placed one after the other; of equal positions source and hash decide; very long texts count whole; extra columns keep
    their values whatever they are named; an empty table stays empty.
    """
    # columns that the operator would replace keep their values under other names meanwhile
    own = dict(zip(clash := [c for c in docs.columns if c.lower() in mixing.ADDED], store.unused(docs, *[f"kept{i}" for i in range(len(clash))])))
    out = mixing.in_order(mixing.mixed(docs.withColumnsRenamed(own)))
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ``position`` and ``shard`` of each document; columns of these names are replaced. Rows lie in files in order of
    position, so that writing a folder a shard (``partitionBy``) takes no shuffle.

    Nulls anywhere, empty and very long texts and repeated rows all get a place; a null source is one of its own; of equal doc_ids
    the hash of the text decides; an empty table stays empty.
    """
    return sharding.sharded(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

# language scores, exact verification and text surgery aren't SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.cut(stage(spark, docs, sf_dir), name)
        store.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
