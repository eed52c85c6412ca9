"""Operator 9: benchmark decontamination with a generalised suffix automaton.

The automaton recognises every run of words of every benchmark item (words as in ``textvec``: runs
of alphanumerics, lower case). The words of a document stream through it and each position gets the
longest match ending there. A run of words of a document is leaked when an item holds it and it has at least
``min_words`` words, or at least ``floor_words`` words and at least ``item_cover`` of that item's. The longest match
at a position isn't the only one that counts: a short item may end a longer match of a long item, so that the matches
along the suffix links, which are all the others that end there, are judged as well; what they give is computed once
for each state. Leaked runs are cut out of the text; a document of which more than ``doc_cover`` of the words is
leaked goes as a whole.

A run can only be leaked where all its runs of ``floor_words`` words occur in the benchmark, which
a bit table over hashes of such runs tells for a whole batch at once; the automaton walks just the
stretches that remain, all of a batch side by side, which changes no result.

Defined results: null and empty texts have no spans; items of fewer than ``floor_words`` words can
never match; runs of one document that touch or overlap are one span, which names, of all items it has a leaked run of,
the one of fewest words, then of least item_id (null ids last); an empty benchmark leaks nothing. What is left
is joined with one blank. Repeated rows each give a row.

The automaton is built on the driver as flat arrays of some 60 bytes a benchmark word and broadcast. A benchmark of more
than ``part_words`` words is cut into parts (an item is never cut), so that the broadcast has that bound; each part is a
pass of its own over the texts, which notes the leaked runs by digest of the text. A last pass joins the runs of all parts
and decides once on the original words. A run is leaked by a single item, so parts give what one automaton would.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .textvec import Words, mix, release, slices

MIN_WORDS, ITEM_COVER, FLOOR_WORDS, DOC_COVER, PART_WORDS = 8, 0.8, 5, 0.6, 500_000
BITS = 22
NONE = np.int32(2**31 - 1)


class Automaton:
    """Generalised suffix automaton over the words of some items (id, text), as flat arrays."""

    def __init__(self, items: list[tuple[int | None, str]], floor: int, min_words: int, cover: float):
        # items in order of length and id, so that of several that have a state the least number is the one to name
        hashed = sorted(((Words([text]).hash, i) for i, text in items), key=lambda x: (len(x[0]), x[1] is None, x[1] or 0))
        sizes = [len(h) for h, _ in hashed]
        self.floor, self.min_words, self.cover = floor, min_words, cover
        self.sizes, self.ids = np.array(sizes, np.int64), [i for _, i in hashed]
        grams = [np.zeros(0, np.uint64)]
        # building goes over dictionaries; what is kept are sorted keys of the transitions
        self._goto: list[dict[int, int]] = [{}]
        self._link, self._length, self._item = [-1], [0], [int(NONE)]
        for n, (h, _) in enumerate(hashed):
            grams.append(runs(h, floor))
            last = 0
            for c in h.tolist():
                last = self._extend(last, c, n)
        self.table = np.zeros(1 << BITS, np.bool_)
        self.table[(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        goto, link, length, item = self._goto, self._link, self._length, self._item
        order = sorted(range(1, len(link)), key=length.__getitem__)
        # an item that has a state has the states its suffix links lead to as well
        for s in reversed(order):
            item[link[s]] = min(item[link[s]], item[s])
        # of the runs that a state's suffix links lead to, itself first: the longest leaked one, and the least item that leaks one
        longest, least = [0] * len(link), [int(NONE)] * len(link)
        for s in order:
            longest[s], least[s] = longest[link[s]], least[link[s]]
            if length[s] >= min_words or length[s] >= floor and length[s] >= cover * sizes[item[s]]:
                longest[s], least[s] = length[s], min(least[s], item[s])
        # the root's link is itself
        link[0] = 0
        self.link, self.length, self.item, self.longest, self.least = (np.array(x, np.int32) for x in (link, length, item, longest, least))
        count = sum(map(len, goto))
        keys = step_keys(np.repeat(np.arange(len(goto)), list(map(len, goto))), np.fromiter((c for g in goto for c in g), np.uint64, count))
        order = np.argsort(keys, kind="stable")
        self.keys, self.to = keys[order], np.fromiter((t for g in goto for t in g.values()), np.int32, count)[order]
        del self._goto, self._link, self._length, self._item

    def _new(self, length: int, item: int, link: int, goto: dict[int, int]) -> int:
        self._goto.append(goto)
        self._link.append(link)
        self._length.append(length)
        self._item.append(item)
        return len(self._goto) - 1

    def _extend(self, last: int, c: int, item: int) -> int:
        goto, link, length = self._goto, self._link, self._length
        if c in goto[last]:
            q = goto[last][c]
            q = q if length[q] == length[last] + 1 else self._split(last, c, q, item)
            self._item[q] = min(self._item[q], item)
            return q
        new = self._new(length[last] + 1, item, 0, {})
        p = last
        while p != -1 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p != -1:
            q = goto[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, item)
        return new

    def _split(self, p: int, c: int, q: int, item: int) -> int:
        clone = self._new(self._length[p] + 1, min(item, self._item[q]), self._link[q], dict(self._goto[q]))
        while p != -1 and self._goto[p].get(c) == q:
            self._goto[p][c] = clone
            p = self._link[p]
        self._link[q] = clone
        return clone

    def leaked(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words ``h`` between each ``begin`` and ``end``, all walked side by side: the words at which leaked
        runs end, the length of the longest one there, and the least item that leaks one."""
        at, stop = begin.copy(), end
        state, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            key = step_keys(state, h[at])
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            root = state == 0
            # without a transition the match gets shorter; at the root it ends, and the word is passed over
            state = np.where(hit, self.to[k], self.link[state])
            n = np.where(hit, n + 1, self.length[state])
            v, m = state[hit], n[hit]
            i = self.item[v]
            own = (m >= self.min_words) | ((m >= self.floor) & (m >= self.cover * self.sizes[i]))
            below = self.link[v]
            longest = np.where(own, m, self.longest[below])
            some = longest > 0
            if some.any():
                found.append((at[hit][some], longest[some], np.where(own, np.minimum(i, self.least[below]), self.least[below])[some]))
            at = at + (hit | root)
            go = at < stop
            if not go.all():
                at, stop, state, n = at[go], stop[go], state[go], n[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found))


def step_keys(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of transitions; two differ but for a chance of 2**-64."""
    return mix(word ^ mix(state.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on, where there are so many."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(out)


def stretches(texts: list[str | None], auto: Automaton) -> Iterator[tuple[int, list[str], Words, np.ndarray, np.ndarray]]:
    """Slices of the texts: index of the first, texts, words, and first word and end of each stretch the automaton has to walk."""
    for start, run in slices(texts):
        w = Words(run)
        grams = runs(w.hash, auto.floor)
        hit = np.flatnonzero(auto.table[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
        doc = np.searchsorted(w.first, hit, side="right") - 1
        inside = hit + auto.floor <= w.first[doc + 1]
        hit, doc = hit[inside], doc[inside]
        if len(hit):
            breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(doc) > 0)) + 1
            yield start, run, w, hit[np.concatenate([[0], breaks])], hit[np.concatenate([breaks - 1, [-1]])] + auto.floor


Span = tuple[int, int, tuple[int, bool, int]]


def joined(spans: list[Span]) -> list[list]:
    """Spans (first word, end, item as (words, whether it has no id, id)), those that touch or overlap as one, of the least item."""
    merged: list[list] = []
    for x, y, item in sorted(spans):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
            merged[-1][2] = min(merged[-1][2], item)
        else:
            merged.append([x, y, item])
    return merged


def matches(texts: list[str | None], auto: Automaton) -> Iterator[tuple[int, Words, int, list[list]]]:
    """For each text with leaked runs: its index, words of its slice, its index there, and its spans in words of the text."""
    names = [(int(n), i is None, i or 0) for n, i in zip(auto.sizes, auto.ids)]
    for start, _, w, begin, end in stretches(texts, auto):
        at, n, item = auto.leaked(w.hash, begin, end)
        doc = np.searchsorted(w.first, at, side="right") - 1
        found: dict[int, list[Span]] = {}
        for d, x, y, i in zip(doc.tolist(), (at + 1 - n - w.first[doc]).tolist(), (at + 1 - w.first[doc]).tolist(), item.tolist()):
            found.setdefault(d, []).append((x, y, names[i]))
        for d in sorted(found):
            yield start + d, w, d, joined(found[d])


Leak = tuple[int, str, list[tuple[int, int, int, int | None]], int]


def _placed(i: int, text: str, w: Words, d: int, spans: list[list]) -> Leak:
    """Index, text, spans (start, end in characters, words, item), words of the text."""
    first, zero = int(w.first[d]), int(w.at[d])
    return i, text, [(int(w.start[first + x]) - zero, int(w.end[first + y - 1]) - zero, y - x, None if none else item) for x, y, (_, none, item) in spans], int(w.first[d + 1]) - first


def leaked(texts: list[str | None], auto: Automaton) -> Iterator[Leak]:
    """The texts with leaked spans."""
    for i, w, d, spans in matches(texts, auto):
        yield _placed(i, texts[i], w, d, spans)


def decided(texts: list[str | None], noted: list[list[bytes] | None]) -> Iterator[Leak]:
    """What :func:`leaked` gives, from the spans of several parts."""
    for i, (text, tables) in enumerate(zip(texts, noted)):
        if tables:
            spans = [(x, y, (n, bool(none), item)) for t in tables for x, y, n, none, item in np.frombuffer(t, np.int64).reshape(-1, 5).tolist()]
            yield _placed(i, text, Words([text]), 0, joined(spans))


def without(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """``text`` without the spans, the rest joined with one blank."""
    parts, at = [], 0
    for a, b, _, _ in spans:
        parts.append(text[at:a].strip())
        at = b
    parts.append(text[at:].strip())
    return " ".join(p for p in parts if p)


def parts_of(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in order of id, in parts of bounded size, one held at a time."""
    now, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).orderBy(F.col("i").asc_nulls_last(), "text")
    for i, text in rows.toLocalIterator():
        n = len(Words([text]).hash)
        if now and size + n > part_words:
            yield now
            now, size = [], 0
        now.append((i, text))
        size += n
    if now:
        yield now


SPANS = "doc_id long, spans array<struct<start_char:int,end_char:int,words:int,item_id:long>>, leaked_words int, words int, dropped boolean, clean_text string"


def found_in(docs: DataFrame, benchmark: DataFrame, floor: int, min_words: int, cover: float, part_words: int, how: str) -> tuple[DataFrame, Broadcast | None] | None:
    """Where the benchmark is one part, ``docs`` and its automaton. Else ``docs`` with the spans of all parts in a last column;
    each part is a pass that ends before the next begins. None without items."""
    spark = docs.sparkSession
    key, found = store.unused(docs, "__key", "__found")
    keyed = docs.withColumn(key, F.sha2(F.col("text").cast("string"), 256))
    plain = keyed.select(key, F.col("text").cast("string").alias("text"))

    def passed(auto: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, np.array([(x, y, *item) for x, y, item in spans], np.int64).tobytes()) for i, _, _, spans in matches(b.column(1).to_pylist(), auto.value)]
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows])), pa.array([t for _, t in rows], pa.binary())], names=[key, found])
                release()

        return store.cut(plain.mapInArrow(run, f"`{key}` string, `{found}` binary"), "matches")

    passes, before = [], None
    for items in parts_of(benchmark, part_words):
        if before is not None:
            passes.append(passed(before))
            before.destroy()
        before = spark.sparkContext.broadcast(Automaton(items, floor, min_words, cover))
    if before is None:
        return None
    if not passes:
        return docs, before
    passes.append(passed(before))
    before.destroy()
    each = reduce(DataFrame.union, passes).groupBy(key).agg(F.collect_set(found).alias(found))
    return keyed.join(each, key, how).drop(key), None


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, item_cover: float = ITEM_COVER, floor: int = FLOOR_WORDS, doc_cover: float = DOC_COVER, part_words: int = PART_WORDS) -> DataFrame:
    """One row for each document with leaked spans."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    how = found_in(plain, benchmark, floor, min_words, item_cover, part_words, "inner")
    if how is None:
        return docs.sparkSession.createDataFrame([], SPANS)
    source, auto = how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], b.column(1).to_pylist()
            for i, text, spans, n in leaked(texts, auto.value) if auto else decided(texts, b.column(2).to_pylist()):
                m = sum(s[2] for s in spans)
                rows.append({"doc_id": b.column(0)[i].as_py(), "spans": [dict(zip(("start_char", "end_char", "words", "item_id"), s)) for s in spans], "leaked_words": m, "words": n, "dropped": m > doc_cover * n, "clean_text": without(text, spans)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return source.mapInArrow(run, SPANS)


ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("words", pa.int32()), ("item_id", pa.int64())]))), ("leaked_words", pa.int32()), ("words", pa.int32()), ("dropped", pa.bool_()), ("clean_text", pa.string())])


def cleaned(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, item_cover: float = ITEM_COVER, floor: int = FLOOR_WORDS, doc_cover: float = DOC_COVER, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with leaked spans cut out and mostly leaked documents dropped; all columns kept, no shuffle of a
    benchmark in one part.

    Where there is a column ``n_chars``, it follows the text.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    width = len(docs.columns)
    how = found_in(docs, benchmark, floor, min_words, item_cover, part_words, "left")
    if how is None:
        return docs
    source, auto = how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, changed = b.column(at).to_pylist(), np.ones(b.num_rows, np.bool_), {}
            for i, text, spans, n in leaked(texts, auto.value) if auto else decided(texts, b.column(width).to_pylist()):
                keep[i] = sum(s[2] for s in spans) <= doc_cover * n
                changed[i] = without(text, spans)
            b = b.select(range(width))
            if changed:
                for i, t in changed.items():
                    texts[i] = t
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if chars >= 0:
                    n_chars = b.column(chars).to_pylist()
                    for i, t in changed.items():
                        n_chars[i] = len(t)
                    b = b.set_column(chars, b.schema.field(chars), pa.array(n_chars, b.schema.field(chars).type))
                b = b.filter(pa.array(keep))
            yield b
            release()

    return source.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
