"""Operator 7: near duplicates by MinHash bands with sequential Bayesian verification.

1. One Arrow pass over the texts gives each document a node key (hash of its words in order, so
   texts equal up to case and punctuation share a node), ``bands * rows`` MinHash values of its word
   shingles (8 bits of each are kept) and a 64-bit key for each band.
2. Documents sharing a band key are candidates. Each bucket is first paired with its smallest node
   only (a star, linear in the bucket's size).
3. Signatures of a pair are compared ``batch`` values at a time; a pair is pruned as soon as the
   posterior probability that its Jaccard similarity reaches ``threshold``, under a uniform prior,
   is below ``miss``. Survivors are verified exactly on their shingle sets.
4. Verified pairs are joined to components. Buckets that still hold several components are then
   compared member by member across components (in blocks of bounded size), so that every candidate
   pair is either tested or already in one component: nothing is capped.

Defined results: documents without words (empty, null, only punctuation) are never duplicates;
the document kept in a group is the one of least ``doc_id`` (null ids come last, then the least
text hash); rows of equal doc_id and text are one document, of which the row stays whose columns as JSON come first, so that
rows repeated whole keep one; extra columns are carried along untouched.
Node and band keys have 64 bits; two different word sequences share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .textvec import Words, mix, powers, release, slices

K, BANDS, ROWS, THRESHOLD, MISS, BATCH, BLOCK = 3, 32, 4, 0.55, 0.005, 16, 2048


@cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32), (x[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhashes(shingles: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (texts x n) of the shingle hashes; ``first`` as from Words.shingles, without empty texts."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    xor, mul = _seeds(n)
    out = np.empty((len(first) - 1, n), np.uint32)
    buf = np.empty_like(x)
    for k in range(n):
        np.bitwise_xor(x, xor[k], out=buf)
        np.multiply(buf, mul[k], out=buf)
        out[:, k] = np.minimum.reduceat(buf, first[:-1])
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(values), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, b * rows + r])
        out[:, b] = h
    return out


SIGNED = "doc_id long, text_hash long, node long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    n = bands * rows
    for batch in batches:
        ids, hashes = batch.column(0), batch.column(1)
        for start, texts in slices(batch.column(2).to_pylist(), 150_000):
            words = Words(texts)
            sh, first = words.shingles(k)
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            at = np.append(first[:-1][some], first[-1])
            values = minhashes(sh, at, n)
            p, _ = powers(len(words.hash) + 1)
            begin = words.first[:-1][some]
            lengths = np.diff(words.first)[some]
            within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            node = mix(np.add.reduceat(words.hash * p[within], begin) + lengths.astype(np.uint64))
            keys = band_keys(values, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(some + start)),
                    hashes.take(pa.array(some + start)),
                    pa.array(node.view(np.int64)),
                    pa.array([row.tobytes() for row in (values & np.uint32(255)).astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc_id", "text_hash", "node", "sig", "bands"],
            )
        release()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Node, 8-bit signature and band keys of each document that has words."""
    return keyed(docs).mapInArrow(lambda it: _sign(it, k, bands, rows), SIGNED)


@cache
def least_matches(threshold: float, miss: float, n: int, batch: int) -> tuple[int, ...]:
    """For each prefix of ``batch``, 2 ``batch``, ... n compared values: the fewest equal ones with
    P(similarity >= threshold | equal ones) >= miss. Values of 8 bits agree by chance once in 256."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for size in range(batch, n + 1, batch):
        for m in range(size + 1):
            like = m * np.log(p) + (size - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= miss:
                break
        out.append(m)
    return tuple(out)


def passes(a: np.ndarray, b: np.ndarray, least: tuple[int, ...], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of signatures that no batch prunes, and their numbers of equal values."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, need in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        equal = equal + (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
        stay = equal >= need
        alive, equal = alive[stay], equal[stay]
    return alive, equal


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _prune(batches: Iterator[pa.RecordBatch], n: int, threshold: float, miss: float, batch: int) -> Iterator[pa.RecordBatch]:
    least = least_matches(threshold, miss, n, batch)
    for rows in batches:
        if rows.num_rows:
            alive, equal = passes(_matrix(rows.column(2), n), _matrix(rows.column(3), n), least, batch)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(alive)), rows.column(1).take(pa.array(alive)), pa.array(equal, pa.int32())], names=["a", "b", "equal"])


def shingle_set(text: str, k: int) -> np.ndarray:
    return np.unique(Words([text]).shingles(k)[0])


def _verify(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    kept: tuple = (None, None)
    for rows in batches:
        a, b = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        ta, tb = rows.column(2).to_pylist(), rows.column(3).to_pylist()
        good, words = [], None
        sets: list[np.ndarray] = []
        for _, run in slices(tb):
            sh, first = Words(run).shingles(k)
            sets += [np.unique(sh[first[i] : first[i + 1]]) for i in range(len(run))]
        for i, y in enumerate(sets):
            if kept[0] != a[i]:
                kept = (a[i], shingle_set(ta[i], k))
            x = kept[1]
            both = np.isin(x, y, assume_unique=True).sum() if len(x) < 20 else int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                good.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])
        release()


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets have a Jaccard similarity of ``threshold`` or more."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify(it, k, threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node of it.

    Alternating large-star and small-star steps (Kiveris et al.), each written to the shared folder.
    """
    now = store.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state.n == 0 or (last is not None and state == last):
            break
        last = state
        both = now.union(now.select("v", "u"))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.withColumn("m", F.min("v").over(w))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done = now
        now = store.cut(small, "edges")
        store.discard(done)
    out = store.cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct()), "components")
    store.discard(now)
    return out


def _cross(first: pd.DataFrame, n: int, threshold: float, miss: float, batch: int) -> pd.DataFrame:
    """Pairs that pass between components, for one bucket and one pair of its blocks."""
    least = least_matches(threshold, miss, n, batch)
    x = first[first.side == 0]
    y = first[first.side == 1] if (first.side == 1).any() else x
    same = y is x
    sx, sy = (np.frombuffer(b"".join(z.sig), np.uint8).reshape(-1, n) for z in (x, y))
    cx, cy, nx, ny = x.component.to_numpy(), y.component.to_numpy(), x.node.to_numpy(), y.node.to_numpy()
    found = []
    for i in range(len(x)):
        js = np.flatnonzero((cy != cx[i]) & (ny > nx[i])) if same else np.flatnonzero(cy != cx[i])
        if len(js):
            alive, _ = passes(np.broadcast_to(sx[i], (len(js), n)), sy[js], least, batch)
            found += [(nx[i], j) for j in ny[js[alive]]]
    a = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": a.min(axis=1) if len(a) else a[:, 0], "b": a.max(axis=1) if len(a) else a[:, 1]})


def near_groups(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, component) for each row that has words: its group."""
    n = bands * rows
    signed = store.cut(signatures(docs, k, bands, rows), "signed")
    sigs = signed.select("node", "sig").dropDuplicates(["node"])
    w = Window.partitionBy("key")
    exploded = signed.select("node", F.explode("bands").alias("key")).distinct()
    multi = store.cut(exploded.withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w)).where("low < high").select("key", "node", "low"), "buckets")
    stars = multi.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()

    def pruned(pairs: DataFrame) -> DataFrame:
        sa, sb = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        return pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(lambda it: _prune(it, n, threshold, miss, batch), "a long, b long, equal int")

    alike = store.cut(pruned(stars), "alike")
    of_node = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("r")).select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        need = of_node.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        t = keyed(docs)
        return t.join(need, t.doc_id.eqNullSafe(need.doc_id) & (t.text_hash == need.text_hash)).select("node", "text").dropDuplicates(["node"])

    texts = store.cut(texts_of(alike), "texts")
    best = alike.groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a")).select("a", "b")
    made = [signed, multi, alike, texts]

    def kept(table: DataFrame) -> DataFrame:
        made.append(table)
        return table

    edges = kept(store.cut(verified(best, texts, k, threshold), "verified"))
    found = kept(components(edges))

    def crossing(pairs: DataFrame) -> DataFrame:
        ca, cb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    more = kept(store.cut(verified(crossing(alike.select("a", "b").join(best, ["a", "b"], "left_anti")), texts, k, threshold), "verified"))
    if not more.isEmpty():
        edges = edges.union(more)
        found = kept(components(edges))

    mixed = multi.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = mixed.withColumn("lo", F.min("component").over(w)).withColumn("hi", F.max("component").over(w)).where("lo < hi").withColumn("size", F.count("*").over(w)).select("key", "node", "component", "size")
    # members are spread over blocks; each pair of blocks of a bucket is one task's work
    mixed = mixed.withColumn("g", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    mixed = mixed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", "node", "component", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    crossed = mixed.join(sigs, "node").groupBy("key", "i", "j").applyInPandas(lambda pdf: _cross(pdf, n, threshold, miss, batch), "a long, b long").distinct()
    rest = kept(store.cut(crossed.join(alike.select("a", "b"), ["a", "b"], "left_anti"), "crossed"))
    if not rest.isEmpty():
        late = kept(store.cut(verified(rest, texts_of(rest), k, threshold), "verified"))
        if not late.isEmpty():
            found = kept(components(edges.union(late)))
    out = store.cut(signed.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component")), "groups")
    store.discard(*made)
    return out


def leavers(groups: DataFrame) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash) of each row that goes, with the row that stays for it."""
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    kept = groups.groupBy("component").agg(keep.alias("k"), F.max(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("z")).where("k <> z").select("component", F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    out = groups.join(kept, "component")
    return out.where(~(out.doc_id.eqNullSafe(out.keep_id) & (out.text_hash == out.keep_hash))).select("doc_id", "text_hash", "keep_id", "keep_hash")


def duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash) of each row that goes, with the row that stays for it.

    Rows of equal doc_id and text are one document here; :func:`deduplicated` keeps one of them.
    """
    return leavers(near_groups(docs, **how))


@store.shielded
def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept."""
    groups = near_groups(docs, **how)
    key, = store.unused(docs, "__text_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__hash"))
    pairs = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = pairs(leavers(groups)).distinct()
    rest = docs.withColumn(key, F.xxhash64(F.col("text"))).join(gone, same, "left_anti")
    # documents of several rows, which only those with words can be
    several = store.cut(pairs(groups).groupBy("__id", "__hash").count().where("count > 1").drop("count"), "repeated")
    if several.isEmpty():
        return rest.drop(key)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rest.join(several, same, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col(key).alias("__hash")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return rest.join(several, same, "left_anti").drop(key).union(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near duplicate of ``documents`` (doc_id) with the document kept for it (keep_id)."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id")
