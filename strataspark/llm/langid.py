"""Operator 10: language identification by cross-parsing entropy.

A suffix automaton of labelled text per language recognises all its substrings. A document is
parsed greedily against each automaton: a phrase is the longest match (at least one character)
from where the last one ended (Ziv and Merhav). The score of a language is
``phrases * log2(characters of its training text) / characters parsed`` in bits a character; the
least score wins. The parse is that of the whole text. It is found in blocks of ``BLOCK`` characters that advance
together in numpy: each block is first parsed from the root, then again from the state that the block before it
ended in, for as long as the two parses differ (mostly a phrase or two), and so on until no block changes.

Text is normalised first: lower case, each character that isn't a letter becomes a blank, and runs
of blanks become one. Training takes ``TRAIN_CHARS`` normalised characters a language from at most
``TRAIN_DOCS`` whole labelled documents of it (those of least hash of doc_id; where the ones of at most
a fifth of ``TRAIN_CHARS`` don't suffice, longer ones, the shortest first), the documented bound
on the sample. Before that, a quarter of the sample of each language with two documents or more, ``HELD_DOCS`` at most and
one at least, is held out. The held-out documents are parsed, and the rejection limit lies between what they score in their own
language and what they score in the nearest other one, at ``REJECT_SHARE`` of the way. The score of n characters
scatters by about ``spread / sqrt(n)``, estimated from the same documents; a document is rejected when its best score is above
the limit by more than ``SIGMAS`` times that, so that a short text needs a worse score than a long one. Here scores don't count
the last phrase, which the end of the text cuts off.

Defined results: no letters at all (empty, null, digits, symbols) gives ``und`` and is rejected; equal scores go to
the language first in alphabetical order. Without any labelled text
every document is ``und``, and kept where it has letters, since nothing can be decided. With one language only, or where no
language has two labelled documents, there is nothing to learn a limit from, and only documents without letters are rejected.
Extra columns are left alone.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textvec import alpha_table, code_points, lower_table, release, slices

BLOCK, TRAIN_CHARS, TRAIN_DOCS, HELD_DOCS, REJECT_SHARE, SIGMAS = 256, 30_000, 150, 60, 0.65, 2.0


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalisation and where each text starts (one more entry than texts)."""
    cp, at = code_points(texts)
    letter = alpha_table()[cp]
    out = np.where(letter, lower_table()[cp], np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1][at[:-1] < len(cp)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions (states x width, -1 for none) of the suffix automaton of codes below ``width``; state 0 is the root.

    One flat array grows with the text; dictionaries for the states would take many times its memory.
    """
    most = 2 * len(text) + 1
    goto, link, length, last, size = array("i", [-1]) * (most * width), array("i", [-1]) * most, array("i", [0]) * most, 0, 1
    for c in text.tolist():
        new = size
        size += 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and goto[p * width + c] == -1:
            goto[p * width + c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = goto[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = size
                size += 1
                goto[clone * width : (clone + 1) * width] = goto[q * width : (q + 1) * width]
                link[clone], length[clone] = link[q], length[p] + 1
                while p != -1 and goto[p * width + c] == q:
                    goto[p * width + c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return np.frombuffer(goto, np.int32)[: size * width].reshape(size, width)


BREAK = np.int32(1 << 30)
TOGETHER, SLICE = 8, 1_000_000


class Model:
    """One table of next states for all languages; a state is the offset of its row."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = [normalised([text])[0] for _, text in samples]
        letters = np.unique(np.concatenate([*texts, np.array([32], np.uint32)]))
        # code 0: never seen in training; the last code: padding, which changes nothing
        width = len(letters) + 2
        code = np.zeros(0x110000, np.uint8 if width < 256 else np.uint16)
        code[letters] = np.arange(1, len(letters) + 1)
        self.code, self.pad, self.roots, self.bits = code, width - 1, [], []
        automata = [suffix_automaton(code[text], width) for text in texts]
        self.table, base = np.empty(sum(map(len, automata)) * width, np.int32), 0
        for i, text in enumerate(texts):
            goto, automata[i] = automata[i], None  # each is given back once it is in the table
            t = self.table[base * width : (base + len(goto)) * width].reshape(goto.shape)
            np.multiply(goto + np.int32(base), np.int32(width), out=t)
            none = goto < 0
            # where no match goes on, a phrase begins: with a character never seen it also ends, in state 0
            begin = np.where(none[0], np.int32(base * width), t[0]) | BREAK
            np.copyto(t, begin[None, :], where=none)
            t[0] = begin
            t[:, self.pad] = (base + np.arange(len(goto))) * width
            self.roots.append(base * width)
            self.bits.append(np.log2(max(2, len(text))))
            base += len(goto)

    def phrases(self, texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (texts x languages) and normalised characters of each."""
        chars, at = normalised(texts)
        lengths = np.diff(at)
        blocks = -(-lengths // block)
        total = int(blocks.sum())
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if total and self.langs:
            grid = np.full(total * block, self.pad, self.code.dtype)
            first = np.cumsum(blocks) - blocks
            grid[np.arange(len(chars)) + np.repeat(first * block - at[:-1], lengths)] = self.code[chars]
            steps = np.ascontiguousarray(grid.reshape(total, block).T)
            some = blocks > 0
            follows = np.ones(total, np.bool_)
            follows[first[some]] = False
            last, count = np.empty((len(self.roots), total), np.int64), np.zeros((len(self.roots), total), np.int64)
            go, flag = np.empty(total, np.int32), np.empty(total, np.int32)
            for state, n, root in zip(last, count, self.roots):
                state[:] = root
                for row in steps:
                    np.add(state, row, out=state)
                    np.take(self.table, state, out=go, mode="clip")
                    np.right_shift(go, 30, out=flag)
                    np.add(n, flag, out=n)
                    np.bitwise_and(go, BREAK - 1, out=state)
            self._carry(steps, last, count, follows)
            out[some] = np.add.reduceat(count, first[some], axis=1).T
        return out, lengths

    def _carry(self, steps: np.ndarray, last: np.ndarray, count: np.ndarray, follows: np.ndarray) -> None:
        """Correct the counts of blocks parsed from the root (languages x blocks) to those of blocks that go on from the one
        before; ``last`` has the states that the blocks end in."""
        total = last.shape[1]
        begun = np.repeat(np.array(self.roots, np.int64), total)
        last, count, follows = last.reshape(-1), count.reshape(-1), np.tile(follows, len(self.roots))
        todo = np.flatnonzero(follows)
        while len(todo):
            before, now = begun[todo], last[todo - 1]
            begun[todo] = now
            lane = todo[before != now]
            a, b = before[before != now], now[before != now]
            # a few steps at a time, between which the lanes that have met drop out; those that meet count alike from there on
            for start in range(0, len(steps), TOGETHER):
                if not len(lane):
                    break
                ga, gb, more = np.empty(len(lane), np.int32), np.empty(len(lane), np.int32), np.zeros(len(lane), np.int32)
                for row in steps[start : start + TOGETHER, lane % total]:
                    for state, go in ((a, ga), (b, gb)):
                        np.add(state, row, out=state)
                        np.take(self.table, state, out=go, mode="clip")
                        np.bitwise_and(go, BREAK - 1, out=state)
                        np.right_shift(go, 30, out=go)
                    np.subtract(gb, ga, out=gb)
                    np.add(more, gb, out=more)
                count[lane] += more
                apart = a != b
                lane, a, b = lane[apart], a[apart], b[apart]
            last[lane] = b
            # those that never met end elsewhere than thought, so the blocks after them begin elsewhere
            lane = lane + 1
            lane = lane[lane < len(last)]
            todo = lane[follows[lane]]

    def scores(self, texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character (texts x languages) and normalised characters."""
        phrases, lengths = self.phrases(texts, block)
        return phrases * np.array(self.bits) / np.maximum(1, lengths)[:, None], lengths


@lru_cache(maxsize=1)
def model_of(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


@dataclass(frozen=True)
class Limit:
    """Best scores above ``bits`` by more than ``SIGMAS * spread / sqrt(characters)`` are rejected."""

    bits: float = math.inf
    spread: float = 0.0

    def keeps(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return scores <= self.bits + SIGMAS * self.spread / np.sqrt(np.maximum(1, lengths))


def training(docs: DataFrame, chars: int = TRAIN_CHARS, most: int = TRAIN_DOCS, held: int = HELD_DOCS) -> tuple[tuple[tuple[str, str], ...], Limit]:
    """Training text by language and the rejection limit, from a bounded sample of labelled documents.

    The sample of a language are the documents of least hash of doc_id, those of at most ``chars / 5``
    characters first, then longer ones from the shortest up. Every fourth of them is held out, ``held`` at most; the others
    are used whole until ``chars`` characters are reached.
    """
    short = F.length("text") <= chars // 5
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.count_if(short), F.count_if(~short)).collect()}
    # a share of the hash range that holds the sample of each language several times over
    share = F.lit(None).cast("double")
    for lang, (n, _) in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 4 * (most + held) / max(1, n) + 1e-9)).otherwise(share)
    near = rows.where(short & (F.col("h") <= (F.coalesce(share, F.lit(1.0)) * 2.0 - 1.0) * float(2**63)))
    w = Window.partitionBy("lang").orderBy("h", "text")
    near = near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most + held)
    own: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for lang, _, text in sorted((r.lang, r.h, r.text) for r in near.collect()):
        own[lang].append(text)

    def taken(texts: list[str]) -> list[str]:
        used, size = [], 0
        while len(used) < min(most, len(texts)) and size < chars:
            n, _ = normalised([texts[len(used)]])
            used.append("".join(map(chr, n)))
            size += len(n)
        return used

    def parted(texts: list[str]) -> tuple[list[str], list[str]]:
        """Documents to train on and documents held out; of two or three, the last."""
        texts = list(dict.fromkeys(texts))
        out = [*range(3, len(texts), 4)][:held] or [len(texts) - 1][: min(held, len(texts) - 1)]
        return [t for i, t in enumerate(texts) if i not in {*out}], [texts[i] for i in out]

    def lacking(texts: list[str]) -> bool:
        own, out = parted(texts)
        used = taken(own)
        return len(used) < most and sum(map(len, used)) < chars or len(out) < min(held, 1)

    longer_of = [lang for lang, texts in own.items() if counts[lang][1] and lacking(texts)]
    if longer_of:
        w = Window.partitionBy("lang").orderBy("size", "h", "text")
        longer = rows.where(~short & F.col("lang").isin(longer_of)).withColumn("size", F.length("text"))
        longer = longer.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most + held)
        for lang, _, _, text in sorted((r.lang, r["size"], r.h, r.text) for r in longer.collect()):
            own[lang].append(text)
    samples, rest = [], []
    for lang, texts in own.items():
        first, out = parted(texts)
        used = taken(first)
        if any(used):
            samples.append((lang, " ".join(used)))
            rest += [(lang, t) for t in out]
    samples = tuple(samples)
    return samples, limit_of(samples, rest)


def unended(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores without the last phrase."""
    return scores - np.array(model.bits) / np.maximum(1, lengths)[:, None]


def limit_of(samples: tuple[tuple[str, str], ...], held: list[tuple[str, str]]) -> Limit:
    """The rejection limit from held-out documents (language, text)."""
    if len(samples) < 2 or not held:
        return Limit()
    model = model_of(samples)
    runs = [model.scores(run) for _, run in slices([t for _, t in held], 1_000_000)]
    n = np.concatenate([x for _, x in runs])
    s = unended(model, np.concatenate([x for x, _ in runs]), n)
    own = np.array([model.langs.index(x) for x, _ in held])
    mine = s[np.arange(len(s)), own]
    others = np.where(np.arange(s.shape[1])[None, :] == own[:, None], np.inf, s).min(axis=1)
    middle = np.median(mine)
    # the median of the deviations times this is a normal one's standard deviation
    spread = 1.4826 * np.median(np.abs(mine - middle) * np.sqrt(n))
    return Limit(float(middle + REJECT_SHARE * (np.median(others) - middle)), float(spread))


def _decide(model: Model, texts: list[str], limit: Limit) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    langs, best, margin, keep = [], [], [], []
    for _, run in slices(texts, SLICE):
        s, n = model.scores(run)
        letters = n > 1
        for i in np.flatnonzero(n == 1):
            letters[i] = any(map(str.isalpha, run[i]))
        if s.shape[1]:
            i = s.argmin(axis=1)
            low = s[np.arange(len(s)), i]
            second = np.partition(s, 1, axis=1)[:, 1] if s.shape[1] > 1 else low
            langs += [model.langs[j] if ok else "und" for j, ok in zip(i, letters)]
            best.append(np.where(letters, low, 0.0))
            margin.append(np.where(letters, second - low, 0.0))
            keep.append(letters & limit.keeps(unended(model, s, n)[np.arange(len(s)), i], n))
        else:
            langs += ["und"] * len(run)
            best.append(np.zeros(len(run)))
            margin.append(np.zeros(len(run)))
            keep.append(letters)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return langs, cat(best, float), cat(margin, float), cat(keep, bool)


def identified(docs: DataFrame, samples: tuple[tuple[str, str], ...], limit: Limit) -> DataFrame:
    """(doc_id, lang, language, bits, margin, keep): the given label, the language found, its score,
    the lead over the next language, and whether the document stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for b in batches:
            langs, best, margin, keep = _decide(model, b.column(2).to_pylist(), limit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(best), pa.array(margin), pa.array(keep)], names=["doc_id", "lang", "language", "bits", "margin", "keep"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, language string, bits double, margin double, keep boolean")


def accepted(docs: DataFrame, samples: tuple[tuple[str, str], ...], limit: Limit) -> DataFrame:
    """``docs`` without the rejected ones, all columns kept; no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for b in batches:
            keep = _decide(model, b.column(at).to_pylist(), limit)[3]
            yield b.filter(pa.array(keep))
            release()

    return docs.mapInArrow(run, docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, *training(docs))
