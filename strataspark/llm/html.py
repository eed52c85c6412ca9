"""Operator 4: HTML main content as a maximum-scoring subsequence.

A page is a sequence of tokens: words of text score positive, tags negative. The contiguous run of
tokens with the greatest sum is the content region (found by one linear scan: the greatest rise of
the running sum), and its words are the extracted text.

Weights come from labelled pages. Tokens fall into classes: words by their kind of surroundings (in a
link, in a heading, in ordinary text), tags by name and direction. Weights start at the smoothed
log-odds of a class being inside labelled content rather than outside and are then moved by an averaged
perceptron until the best region of the labelled pages is their content; words stay at ``LEAST_WORD``
or more and tags at ``-LEAST_TAG`` or less, so that the signs are those of the method. Labels are pages whose
authors marked the content with ``<article>`` or ``<main>``; those two tags themselves get the weight of
an unknown tag, so they help no page at extraction. Training uses at most ``TRAIN_PAGES`` labelled
pages, those of least hash of page_id: the documented bound.

Attribute values may hold ``<`` and, unless they are quoted, quotes; a tag ends at the next ``>`` outside a quoted value, and one without
an end takes the rest of the page. No part of a tag is ever text.

Defined results: null, empty and tag-only pages give empty text and the region (-1, -1); of regions with equal
sums the one that ends first wins, and of those the one that begins last; script, style, head
titles and comments are dropped before scoring; entities are decoded; block tags end a line. Without
labelled pages every word weighs 1 and every tag -1.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES, EPOCHS, LEAST_WORD, LEAST_TAG, UNKNOWN = 1000, 4, 0.05, 0.05, -1.0

# quotes only matter right behind an equals sign; a tag that never ends runs to the end of the page, as in browsers
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
MARKS = {"article", "main"}
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "nav", "footer", "header", "blockquote", "pre", "td", "aside", "form"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def tokens(page: str) -> tuple[list[str], list[list[str] | None], list[tuple[int, int]]]:
    """Classes, words (None for a tag) and places of the tags and of the texts between them.

    All words between two tags have one class, so the best region takes them all or none.
    """
    classes, words, places = [], [], []
    link = head = 0
    for m in TOKEN.finditer(page):
        name = m.group(3)
        if name:
            name = name.lower()
            closing = bool(m.group(2))
            if name == "a":
                link = 0 if closing else 1
            elif name in HEADS:
                head = 0 if closing else 1
            classes.append(("/" if closing else "") + name)
            words.append(None)
            places.append(m.span())
        elif not (m.group(1) or m.group().startswith(("<!", "<?", "</"))) and (found := m.group().split()):
            classes.append("#link" if link else "#head" if head else "#text")
            words.append(found)
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            places.append((begin, m.start() + len(m.group().rstrip())))
    return classes, words, places


def best_region(weights: np.ndarray) -> tuple[int, int]:
    """[first, end) of the contiguous run with the greatest positive sum; (-1, -1) where none is positive."""
    if not len(weights):
        return -1, -1
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    low = np.minimum.accumulate(sums)
    rise = sums[1:] - low[:-1]
    end = int(rise.argmax())
    if rise[end] <= 0:
        return -1, -1
    first = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return first, end + 1


def text_of(classes: list[str], words: list[list[str] | None]) -> str:
    """Words joined by blanks; block tags end lines."""
    out, line = [], []
    for c, w in zip(classes, words):
        if w is not None:
            line += w
        elif c.lstrip("/") in BLOCKS and line:
            out.append(" ".join(line))
            line = []
    if line:
        out.append(" ".join(line))
    return entities.unescape("\n".join(out))


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, int, int, float]:
    """Text, region in characters, and score of a page."""
    classes, words, places = tokens(page or "")
    default = weights.get("#text", 1.0)
    w = np.array([weights.get(c, default) * len(x) if x else weights.get(c, UNKNOWN) for c, x in zip(classes, words)])
    a, b = best_region(w)
    if a < 0:
        return "", -1, -1, 0.0
    return text_of(classes[a:b], words[a:b]), places[a][0], places[b - 1][1], round(float(w[a:b].sum()), 6)


def learn(pages: list[str]) -> dict[str, float]:
    """Weight of each token class from pages with exactly one marked content region."""
    inside, outside, gold = Counter(), Counter(), []
    for page in pages:
        classes, words, _ = tokens(page)
        marks = [i for i, c in enumerate(classes) if c.lstrip("/") in MARKS]
        if len(marks) == 2 and classes[marks[1]] == "/" + classes[marks[0]]:
            a, b = marks
            for i, (c, w) in enumerate(zip(classes, words)):
                if i not in marks:
                    (inside if a < i < b else outside)[c] += len(w or "x")
            gold.append((classes, np.array([len(w or "x") for w in words], float), a + 1, b))
    if not inside:
        return {}
    ni, no = sum(inside.values()), sum(outside.values())
    names = sorted({*inside, *outside} - MARKS - {"/" + m for m in MARKS})
    at = {c: i for i, c in enumerate(names)}
    odds = [np.log((inside[c] + 1) / (ni + 1)) - np.log((outside[c] + 1) / (no + 1)) for c in names]
    word = np.array([c[0] == "#" for c in names])
    fix = lambda v: np.append(np.where(word, np.maximum(v, LEAST_WORD), np.minimum(v, -LEAST_TAG)), UNKNOWN)
    weights, total, n = fix(np.array(odds)), np.zeros(len(names) + 1), 0
    # then move the weights until the best region of a labelled page is its content (an averaged perceptron)
    coded = [(np.array([at.get(c, len(names)) for c in classes]), size, a, b) for classes, size, a, b in gold]
    for _ in range(EPOCHS):
        for ids, size, a, b in coded:
            x, y = best_region(weights[ids] * size)
            if (x, y) != (a, b):
                want = np.bincount(ids[a:b], size[a:b], len(names) + 1)
                step = want - np.bincount(ids[x:y], size[x:y], len(names) + 1) if x >= 0 else want
                if step.any():
                    weights = fix((weights + step / np.abs(step).sum())[:-1])
            total += weights
            n += 1
    return {c: round(float(total[i] / n), 6) for c, i in at.items()}


def labelled_pages(pages: DataFrame, most: int = TRAIN_PAGES) -> list[str]:
    """The texts of the ``most`` marked pages of least hash. A first pass finds the greatest of their hashes from ids alone, so
    that no task sends more than the pages that are used."""
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)</(article|main)\s*>")).withColumn("h", F.xxhash64("page_id"))
    last = marked.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r.html for r in marked.where(F.col("h") <= last).orderBy("h", "page_id", "html").limit(most).collect()]


@cache
def _table(items: tuple[tuple[str, float], ...]) -> dict[str, float]:
    return dict(items)


def extracted(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, text, start_char, end_char, score) of every page; no shuffle."""
    items = tuple(sorted(weights.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(items)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                rows = [extract(p, table) for p in part.column(1).to_pylist()]
                text, start, end, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())], names=["page_id", "text", "start_char", "end_char", "score"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, start_char int, end_char int, score double")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, learn(labelled_pages(pages)))
