"""Operator 5: mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1 and consumes ``budget`` tokens. Each source has a weight schedule,
linear between knots; the weights of all sources add up to 1 at every time. Its integral times the
budget is the source's cumulative demand of tokens. Documents of a source are put in seeded order; a
document starts where so many tokens of its source have been consumed as come before it, and its
training position is the time at which the demand reaches that number: the inverse of the
cumulative demand (the root of a quadratic between two knots). Documents are range-sorted by position.

A source that is demanded less than it has loses the documents at the end of its seeded order; one
that is demanded more begins again, for ``max_epochs`` epochs at most. Where it is demanded more than
that, its weights are lowered by one factor over the whole of time, so that the last epoch ends with
training, and the weights of the other sources are raised at each knot in proportion to fill up to 1;
one that this lifts over its own epochs is lowered in turn. Where no other source has weight at a knot,
the weights add up to less than 1 there, as there is nothing left to train on.

The default schedule starts at the sources' own shares of all tokens and ends at shares proportional to their
square roots, which favours small sources late; the default budget is the number of all tokens.
Tokens are counted as words between blanks.

Defined results: a null source is a source of its own; documents without words (empty, null, blank)
carry nothing to train on and get no position; sources missing from a given schedule have weight 0;
repeated rows are placed one after the other; positions are rounded to nine digits, and equal ones are ordered by source and hash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sharding import BUCKET_DIGITS, bucket_offsets, bucketed_running, seeded, stratum

SEED, MAX_EPOCHS = "strata-5", 4
ADDED = ("n_tokens", "epoch", "position")
WORD = r"[^ \t\n\r\f]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def default_schedule(held: Mapping[str, int]) -> dict[str, list[tuple[float, float]]]:
    """From the sources' own shares to shares by square root."""
    total = float(sum(held.values())) or 1.0
    roots = sum(float(n) ** 0.5 for _, n in sorted(held.items())) or 1.0
    return {s: [(0.0, n / total), (1.0, float(n) ** 0.5 / roots)] for s, n in held.items()}


def segments(schedule: Mapping[str, Sequence[tuple[float, float]]], budget: float, most: Mapping[str, float] | None = None) -> list[tuple[str, float, float, float, float, float]]:
    """(source, time, length, weight at its start, rise of the weight, demand before) of each stretch between knots; no source demands more than ``most`` tokens."""
    times = sorted({0.0, 1.0, *(t for knots in schedule.values() for t, _ in knots)})

    def at(knots: Sequence[tuple[float, float]], t: float) -> float:
        knots = sorted(knots)
        if t <= knots[0][0]:
            return knots[0][1]
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if t <= b:
                return x + (y - x) * (t - a) / (b - a)
        return knots[-1][1]

    sums = {t: sum(at(k, t) for _, k in sorted(schedule.items())) or 1.0 for t in times}
    weights = lasting({s: [at(k, t) / sums[t] for t in times] for s, k in sorted(schedule.items())}, times, budget, most or {})
    out = []
    for s, w in weights.items():
        before = 0.0
        for t, u, x, y in zip(times, times[1:], w, w[1:]):
            out.append((s, t, u - t, x, y - x, before))
            before += budget * (u - t) * (x + y) / 2
    return out


def lasting(weights: dict[str, list[float]], times: Sequence[float], budget: float, most: Mapping[str, float]) -> dict[str, list[float]]:
    """Weights at the knots, lowered where a source would demand more than ``most`` tokens, the others raised."""

    def demand(w: list[float]) -> float:
        return budget * sum((u - t) * (x + y) / 2 for t, u, x, y in zip(times, times[1:], w, w[1:]))

    weights, full = dict(weights), set()
    while over := [s for s, w in weights.items() if s in most and s not in full and demand(w) > most[s]]:
        for s in over:
            factor = most[s] / demand(weights[s])
            weights[s] = [x * factor for x in weights[s]]
        full |= {*over}
        for k in range(len(times)):
            room = 1.0 - sum(w[k] for s, w in weights.items() if s in full)
            free = sum(w[k] for s, w in weights.items() if s not in full)
            if free:
                for s in weights.keys() - full:
                    weights[s] = [*weights[s][:k], weights[s][k] * room / free, *weights[s][k + 1 :]]
    return weights


@store.shielded
def mixed(docs: DataFrame, schedule: Mapping[str | None, Sequence[tuple[float, float]]] | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED, source: str = "source", digits: int = BUCKET_DIGITS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``epoch`` (from 0) and ``position`` (0 to 1); a document has a row for each epoch it is used in.

    Columns of ``docs`` with these names are replaced. The rows come unsorted, see :func:`in_order`.
    """
    docs = docs.drop(*ADDED)
    g, h, b, c = store.unused(docs, "__g", "__h", "__b", "__c")
    light = docs.select("doc_id", source, "text").select(stratum(source).alias(g), F.substring(seeded(seed), 1, digits).alias(b), words("text").alias("n_tokens")).where("n_tokens > 0")
    held_by_bucket = store.cut(light.groupBy(g, b).agg(F.sum("n_tokens").alias("n")), "tokens")
    # one row a source; what follows from it are constants of the plan
    held = {r[0]: r[1] for r in held_by_bucket.groupBy(g).agg(F.sum("n")).collect()}
    if not held:
        return docs.limit(0).withColumns({"n_tokens": F.lit(0).cast("long"), "epoch": F.lit(0), "position": F.lit(0.0)})
    total = sum(held.values())
    budget = total if budget is None else budget
    named = default_schedule(held) if schedule is None else {("n" if s is None else "s" + s): k for s, k in schedule.items()}
    parts = [p for p in segments(named, float(budget), {s: float(max_epochs) * n for s, n in held.items()}) if p[0] in held]
    spark = docs.sparkSession
    plan: dict[str, list] = {}
    for s, t, length, x, rise, before in parts:
        plan.setdefault(s, []).append((t, length, x, rise, before, before + budget * length * (x + x + rise) / 2))
    rows = [(s, n, min(plan[s][-1][5], float(max_epochs) * n), plan[s]) for s, n in held.items() if s in plan]
    table = spark.createDataFrame(rows, f"{g} string, __held long, __demand double, __plan array<struct<t:double,len:double,x:double,rise:double,lo:double,hi:double>>")
    offsets = bucket_offsets(held_by_bucket, g, b, F.col("n"))
    keyed = docs.withColumn("n_tokens", words("text")).where("n_tokens > 0").withColumn(g, stratum(source)).withColumn(h, seeded(seed)).withColumn(b, F.substring(h, 1, digits))
    ranked = bucketed_running(keyed, g, [h, "doc_id", F.xxhash64("text")], b, c, offsets, F.col("n_tokens")).withColumn(c, F.col(c) - F.col("n_tokens"))
    used = ranked.join(table, g).where(F.col(c) < F.col("__demand"))
    epochs = F.greatest(F.ceil((F.col("__demand") - F.col(c)) / F.col("__held")) - 1, F.lit(0)).cast("int")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs)))
    need = F.col("epoch") * F.col("__held") + F.col(c)
    used = used.withColumn(c, need).where(F.col(c) < F.col("__demand"))
    part = F.element_at(F.filter("__plan", lambda p: p["lo"] <= F.col(c)), -1)
    # budget * (x * d + rise * d**2 / (2 * len)) = tokens wanted within the stretch
    want = (F.col(c) - F.col("__p.lo")) / F.lit(float(budget))
    root = F.sqrt(F.greatest(F.col("__p.x") * F.col("__p.x") + 2.0 * F.col("__p.rise") / F.col("__p.len") * want, F.lit(0.0)))
    step = F.when(want <= 0, F.lit(0.0)).otherwise(2.0 * want / (F.col("__p.x") + root))
    used = used.withColumn("__p", part).withColumn("position", F.round(F.least(F.col("__p.t") + step, F.lit(1.0)), 9))
    return used.drop(g, h, b, c, "__p", "__plan", "__held", "__demand", "__before", "__all")


def in_order(placed: DataFrame, source: str = "source", seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """Range-sorted by position. By construction positions are even in tokens, so equal ranges of
    them are equal shares of the work and no sampling pass is needed to find the ranges."""
    spark = placed.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("position") * n), F.lit(n - 1)).cast("int")
    return placed.repartitionById(n, part).sortWithinPartitions("position", stratum(source), seeded(seed), "epoch")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return in_order(mixed(docs).drop("text"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS g,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL),
k AS (SELECT * FROM d WHERE n_tokens > 0),
s AS (SELECT g, CAST(sum(n_tokens) AS BIGINT) AS held FROM k GROUP BY g),
t AS (SELECT CAST(sum(held) AS DOUBLE) AS budget, sum(sqrt(held::DOUBLE)) AS roots FROM s),
w AS (SELECT g, held, budget, held / budget AS x, sqrt(held::DOUBLE) / roots - held / budget AS rise,
             least(budget * (held / budget + sqrt(held::DOUBLE) / roots) / 2, {MAX_EPOCHS}.0 * held) AS demand FROM s, t),
c AS (SELECT doc_id, source, g, n_tokens, CAST(sum(n_tokens) OVER (PARTITION BY g ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS c FROM k),
e AS (SELECT c.*, w.* EXCLUDE (g), CAST(epoch AS INTEGER) AS epoch, epoch * held + c AS need FROM c JOIN w USING (g), range({MAX_EPOCHS}) r(epoch) WHERE epoch * held + c < demand)
SELECT doc_id, source, n_tokens, epoch,
       round(least(CASE WHEN need <= 0 THEN 0.0::DOUBLE ELSE 2 * (need / budget) / (x + sqrt(greatest(x * x + 2 * rise * (need / budget), 0.0::DOUBLE))) END, 1.0::DOUBLE), 9) AS position FROM e
"""
