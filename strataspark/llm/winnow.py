"""Operator 8: document fingerprints by winnowing.

A text is reduced to its letters and digits in lower case. Each run of ``k`` of them gets a hash; of
every ``window`` consecutive hashes the least is chosen, the rightmost of equal ones. Two texts that
share ``window + k - 1`` reduced characters share a fingerprint, and no match shorter than ``k`` is
ever seen, except that a text of fewer has one fingerprint, of all it has, so that short copies are seen whole. Positions are those of the first character of the run in the original text.

Defined results: without letters and digits (empty and null texts too) there are empty arrays;
fewer than ``window`` hashes count as one window. Repeated rows give repeated rows; extra columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import code_points, lower_table, mix, powers, slices, word_table

K, WINDOW = 40, 60


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Index of the least of each ``window`` consecutive values, the rightmost of equal ones."""
    best, span = np.arange(len(h)), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return best


def fingerprints(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of all texts, and where each text's begin (one more entry than texts)."""
    cp, at = code_points(texts)
    table = word_table()[cp] & (cp != 95)
    where = np.flatnonzero(table)
    low = lower_table()[cp[where]].astype(np.uint64) + np.uint64(1)
    first = np.searchsorted(where, at)
    n = len(low)
    hashes, positions, counts = [], [], np.zeros(len(texts) + 1, np.int64)
    if n:
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low * p[:n], out=sums[1:])
        grams = mix((sums[k:] - sums[:-k]) * q[: n - k + 1]) if n >= k else np.zeros(0, np.uint64)
        # windows over all texts at once; those that lie in one text count
        whole = rightmost_minima(grams, window) if len(grams) >= window else np.zeros(0, np.int64)
        for i in range(len(texts)):
            a, b = int(first[i]), int(first[i + 1]) - k + 1
            if b - a <= 0:
                z = int(first[i + 1])
                if z > a:  # the number of characters is mixed in, so that no longer run has this hash
                    hashes.append(mix(mix((sums[z : z + 1] - sums[a]) * q[a]) + np.uint64(z - a)))
                    positions.append(where[a : a + 1] - at[i])
                    counts[i + 1] = 1
                continue
            if b - a >= window:
                m = whole[a : b - window + 1]
                m = m[np.concatenate([[True], m[1:] != m[:-1]])]
            else:
                g = grams[a:b]
                m = np.array([a + len(g) - 1 - int(np.argmin(g[::-1]))])
            hashes.append(grams[m])
            positions.append(where[m] - at[i])
            counts[i + 1] = len(m)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(hashes, np.uint64), cat(positions, np.int64), np.cumsum(counts)


SCHEMA = "doc_id long, hashes array<long>, positions array<int>"


def fingerprinted(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in slices(b.column(1).to_pylist()):
                h, pos, at = fingerprints(texts, k, window)
                offsets = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))],
                    names=["doc_id", "hashes", "positions"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
