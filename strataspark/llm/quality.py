"""Operator 1: quality classifier, a generalised additive model with pairwise interactions.

Training (on the driver, on at most ``TRAIN_ROWS`` labelled documents, those of least hash of doc_id:
the documented bound on the sample) bins each feature at its quantiles and boosts cyclically: each
round visits every feature in turn and adds a shallow tree on that feature alone (``LEAVES`` leaves,
found on the histogram of gradients) to the feature's table. Then the ``PAIRS`` pairs of features
whose best two-by-two cut gains most on the residuals get tables of their own, boosted the same way.
A score is the intercept plus one table entry per feature and pair: additions over whole columns.

Two targets are learned: ``quality`` and ``toxic``. Features are measured on the whole text: sizes, shares of
kinds of characters, repetition of words and lines, and the weights of words in lexicons learned
from the sample (log-odds of the words, and of beginnings of words, that lean to one class).

Defined results: null and empty texts have all features 0 and are scored like any other; labels of
null count as unlabelled; repeated labels of a document count each time; without labels, or with one
class only, the score is the share of positives (0.5 without labels). Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import alpha_table, lower_table, mix, powers, release, slices, Words

TRAIN_ROWS, BINS, LEAVES, ROUNDS, RATE, PAIRS, PAIR_BINS, LEXICON_LEAST = 12000, 48, 4, 60, 0.15, 8, 12, 4
BEGINNINGS = (3, 4, 5, 6, 7)

NAMES = ("chars", "words", "word_length", "letters", "digits", "upper", "symbols", "bang", "pipe", "blank", "lines", "distinct_words", "top_word", "same_lines", "toxic_most", "toxic_rate", "bad_most", "bad_rate", "toxic_begin_most", "toxic_begin_rate")


@dataclass
class Lexicon:
    """Weights of word hashes (sorted)."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(x)])
    return s[at[1:]] - s[at[:-1]]


def _repeats(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and the count of the most frequent one, of each group."""
    different, most = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, group))
        k, g = keys[order], group[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])]))
        counts = np.diff(np.append(new, len(k)))
        different = np.bincount(g[new], minlength=n).astype(float)
        np.maximum.at(most, g[new], counts)
    return different, most


def _per_word(w: Words, lex: Lexicon) -> np.ndarray:
    """For each word the greatest weight of one of its proper beginnings."""
    out = np.zeros(len(w.hash))
    if len(lex.keys):
        for k in BEGINNINGS:
            at, h = w.beginnings(k)
            out[at] = np.maximum(out[at], lex.of(h))
    return out


def features(texts: list[str], toxic: Lexicon, bad: Lexicon, starts: Lexicon = Lexicon()) -> np.ndarray:
    """Texts x features."""
    w = Words(texts)
    cp, at, n = w.cp, w.at, len(texts)
    chars, words = np.diff(at).astype(float), np.diff(w.first).astype(float)
    safe, some = np.maximum(1, chars), np.maximum(1, words)
    letter = alpha_table()[cp]
    letters = _sums(letter, at)
    ascii_kind = np.zeros(128, np.uint8)  # 1 digit, 2 symbol, 3 blank, 4 plain punctuation
    for c in range(128):
        ch = chr(c)
        ascii_kind[c] = 1 if ch.isdigit() else 0 if ch.isalpha() else 3 if ch.isspace() else 4 if ch in ".,;:'\"?-()" else 2
    kind = np.where(cp < 128, ascii_kind[np.minimum(cp, 127)], 0)
    upper = letter & (lower_table()[cp] != cp)
    group = np.repeat(np.arange(n), np.diff(w.first))
    different, most = _repeats(w.hash, group, n)
    # lines by the same prefix sums as words
    newline = cp == 10
    p, q = powers(len(cp) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[: len(cp)], dtype=np.uint64)])
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], np.flatnonzero(newline) + 1]))
    begin = begin[begin < len(cp)]
    line_doc = np.searchsorted(at, begin, side="right") - 1
    ends = np.append(begin[1:], len(cp))
    ends = np.minimum(ends, at[line_doc + 1])
    ends = ends - (newline[np.maximum(ends - 1, 0)] & (ends > begin))
    full = ends > begin
    lines = mix((sums[ends] - sums[begin]) * q[begin])[full]
    line_doc = line_doc[full]
    line_count = np.bincount(line_doc, minlength=n).astype(float)
    line_different, _ = _repeats(lines, line_doc, n)
    out = [
        np.log1p(chars), np.log1p(words), _sums(w.end - w.start, w.first) / some, letters / safe, _sums(kind == 1, at) / safe, _sums(upper, at) / np.maximum(1, letters),
        _sums(kind == 2, at) / safe, _sums(cp == 33, at) / safe, _sums(cp == 124, at) / safe, _sums(kind == 3, at) / safe, _sums(newline, at) / some,
        different / some, most / some, 1 - line_different / np.maximum(1, line_count),
    ]
    for x in (toxic.of(w.hash), bad.of(w.hash), _per_word(w, starts)):
        top = np.zeros(n)
        np.maximum.at(top, group, x)
        out += [top, _sums(x, w.first) / some]
    return np.column_stack(out)


def _by_document(doc: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(doc, kind="stable")
    ends = np.searchsorted(doc[order], np.arange(n + 1))
    return [np.unique(h[order[a:b]]) for a, b in zip(ends[:-1], ends[1:])]


def lexicon(texts: list[str], y: np.ndarray, least: int = LEXICON_LEAST, lean: float = 1.0, beginnings: tuple[int, ...] = ()) -> Lexicon:
    """Words whose documents lean to class 1, with smoothed log-odds as weights; with ``beginnings`` not
    words but their proper beginnings of these lengths, which also tell forms that the sample doesn't have."""
    seen: list[np.ndarray] = []
    for _, run in slices(texts):
        w = Words(run)
        if beginnings:
            own = [w.beginnings(k) for k in beginnings]
            at, h = np.concatenate([a for a, _ in own]), np.concatenate([x for _, x in own])
            doc = np.searchsorted(w.first, at, side="right") - 1
            seen += _by_document(doc, h, len(run))
        else:
            seen += [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
    pos, neg = ([s for s, v in zip(seen, y) if v == c] for c in (1, 0))
    if not pos or not neg:
        return Lexicon()
    kp, cp = np.unique(np.concatenate(pos), return_counts=True)
    kn, cn = np.unique(np.concatenate(neg), return_counts=True)
    at = np.minimum(np.searchsorted(kn, kp), max(0, len(kn) - 1))
    other = np.where(kn[at] == kp, cn[at], 0) if len(kn) else np.zeros(len(kp))
    odds = np.log((cp + 0.5) / (len(pos) + 1)) - np.log((other + 0.5) / (len(neg) + 1))
    keep = (cp >= least) & (odds >= lean)
    return Lexicon(kp[keep], odds[keep])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """Values by bin of a tree with so many leaves at most, grown best first on a histogram."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        x = gain(a, m) + gain(m, b) - gain(a, b)
        return float(x.max()), int(m[x.argmax()])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(best(a, b), i) for i, (a, b) in enumerate(parts)]
        (x, m), i = max(found, key=lambda f: f[0][0])
        if x <= 1e-12:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, m), (m, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _quad(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best two-by-two cut of two-dimensional histograms."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not a.size:
        return 0.0, np.zeros_like(g)
    quads = []
    for S in (G, H):
        ll, lr, rl = S[a, b], S[a, -1] - S[a, b], S[-1, b] - S[a, b]
        quads.append((ll, lr, rl, S[-1, -1] - ll - lr - rl))
    x = sum(qg**2 / (qh + l2) for qg, qh in zip(*quads)) - G[-1, -1] ** 2 / (H[-1, -1] + l2)
    i = int(x.argmax())
    v = [-qg.ravel()[i] / (qh.ravel()[i] + l2) for qg, qh in zip(*quads)]
    m, k = int(a.ravel()[i]), int(b.ravel()[i])
    out = np.empty_like(g)
    out[:m, :k], out[:m, k:], out[m:, :k], out[m:, k:] = v
    return float(x.ravel()[i]), out


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, leaves: int = LEAVES, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, pair_bins: int = PAIR_BINS) -> Additive:
    """Boost the additive model for logistic loss."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    d = x.shape[1]
    model = Additive(float(np.log(share / (1 - share))), [_edges(x[:, j], bins) for j in range(d)], [], [_edges(x[:, j], pair_bins) for j in range(d)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    out = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-out))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            m = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, m), np.bincount(at[j], h, m), leaves)
            model.tables[j] += step
            out += step[at[j]]
    pat = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(pat[i] * size[j] + pat[j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    ranked = sorted(((_quad(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for gain, i, j in ranked if gain > 0]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _quad(grid(i, j, g), grid(i, j, h))[1]
            table += step
            out += step[pat[i], pat[j]]
    return model


@dataclass
class Classifier:
    toxic_words: Lexicon
    bad_words: Lexicon
    toxic_beginnings: Lexicon
    quality: Additive
    toxic: Additive
    quality_at: float = 0.5
    toxic_at: float = 0.5

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        good, toxic = [np.zeros(0)], [np.zeros(0)]
        for _, run in slices(texts):
            x = features(run, self.toxic_words, self.bad_words, self.toxic_beginnings)
            good.append(self.quality.score(x))
            toxic.append(self.toxic.score(x))
        return np.concatenate(good), np.concatenate(toxic)


def train(texts: list[str], quality: np.ndarray, toxic: np.ndarray) -> Classifier:
    """Fit both targets. Lexicons are learned on one half and weighed by the tables on the other, so
    that words seen by chance in one class earn no trust."""
    half = np.arange(len(texts)) % 2 == 0
    pick = lambda m: [t for t, k in zip(texts, m) if k]
    toxic_words, bad_words = lexicon(pick(half), toxic[half]), lexicon(pick(half), 1 - quality[half])
    begin = lexicon(pick(half), toxic[half], lean=1.5, beginnings=BEGINNINGS)
    other = pick(~half)
    x = np.concatenate([features(run, toxic_words, bad_words, begin) for _, run in slices(other)]) if other else np.zeros((0, len(NAMES)))
    return Classifier(toxic_words, bad_words, begin, fit(x, quality[~half]), fit(x, toxic[~half]))


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The bounded sample of labelled documents: texts, quality, toxic."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(most)
    # the sample's rows are bounded by ``most``, so they may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    # one id may have any number of texts and repeated rows: those of least hash are taken, each once
    last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["doc_id", "text", "quality", "toxic"])
    got = rows.select("doc_id", "text", "quality", "toxic").toPandas().sort_values(["doc_id", "text", "quality", "toxic"])
    return got.text.tolist(), got.quality.to_numpy(float), got.toxic.to_numpy(float)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every document: two probabilities and whether the document
    is good enough and not toxic; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, toxic = model.scores(b.column(1).to_pylist())
            keep = (good >= model.quality_at) & (toxic < model.toxic_at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good), pa.array(toxic), pa.array(keep)], names=["doc_id", "quality", "toxic", "keep"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality double, toxic double, keep boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
