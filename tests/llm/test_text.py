"""Operators that read one row at a time, against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import decontaminate, langid, quality, textvec, winnow

ODD = [None, "", " ", "!!! ...", "a", "İstanbul Straße", "x" * 50_000, "word " * 30_000, "tab\tand\nline", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "ein zwei ein zwei"]


def words(text):
    return [textvec.lower_char_text(w) for w in re.findall(r"\w+", text or "")]


def is_word(c):
    return c.isalnum() or c == "_"


def plain_words(text):
    out, now = [], ""
    for c in text or "":
        if is_word(c):
            now += c
        elif now:
            out.append(now)
            now = ""
    return [textvec.lower_char_text(w) for w in out + [now] * bool(now)]


def test_words_are_those_of_plain_python():
    texts = [t or "" for t in ODD] + ["alpha beta", "beta", "Alpha  BETA."]
    w = textvec.Words(texts)
    hashes = {}
    for i, t in enumerate(texts):
        own = w.hash[w.first[i] : w.first[i + 1]].tolist()
        plain = plain_words(t)
        assert len(own) == len(plain)
        for h, p in zip(own, plain):
            assert hashes.setdefault(p, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_adjacent_texts_stay_apart():
    w = textvec.Words(["ab", "cd"])
    assert len(w.hash) == 2 and w.first.tolist() == [0, 1, 2]
    assert w.hash[0] == textvec.Words(["ab cd"]).hash[0] and w.hash[1] == textvec.Words(["xx cd"]).hash[1]


def test_beginnings():
    w = textvec.Words(["abcdef abcxyz abc ab"])
    at, h = w.beginnings(3)
    assert at.tolist() == [0, 1] and h[0] == h[1]


# -- winnowing


def brute_winnow(text, k, window):
    kept = [(i, textvec.lower_char_text(c)) for i, c in enumerate(text or "") if is_word(c) and c != "_"]
    grams = ["".join(c for _, c in kept[i : i + k]) for i in range(len(kept) - k + 1)]
    hashes = []
    for g in grams:
        cp = np.array([ord(c) for c in g], np.uint64) + np.uint64(1)
        p, _ = textvec.powers(k + 1)
        hashes.append(int(textvec.mix(np.array([(cp * p[:k]).sum(dtype=np.uint64)]))[0]))
    if kept and not hashes:
        return [("whole", "".join(c for _, c in kept))], [kept[0][0]]
    out = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        m = min(part)
        j = i + max(x for x, h in enumerate(part) if h == m)
        if not out or out[-1] != j:
            out.append(j)
    return [hashes[j] for j in out], [kept[j][0] for j in out]


@pytest.mark.parametrize("k,window", [(3, 4), (5, 1), (8, 16)])
def test_winnow_is_brute_force(k, window):
    rng = random.Random(k)
    texts = [t or "" for t in ODD if len(t or "") < 1000] + ["".join(rng.choice("ab c.") for _ in range(rng.randrange(200))) for _ in range(60)]
    h, pos, at = winnow.fingerprints(texts, k, window)
    short = {}
    for i, t in enumerate(texts):
        hashes, places = brute_winnow(t, k, window)
        got = h[at[i] : at[i + 1]].tolist()
        if hashes and isinstance(hashes[0], tuple):  # texts of fewer than k: one hash a content
            assert len(got) == 1 and short.setdefault(hashes[0][1], got[0]) == got[0]
        else:
            assert got == hashes, t
        assert pos[at[i] : at[i + 1]].tolist() == places, t
    assert len(set(short.values())) == len(short)


def test_winnow_of_long_texts_and_repeated_rows(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefg hij.") for _ in range(30_000))
    h, pos, at = winnow.fingerprints(["x", long, long], 8, 16)
    want = brute_winnow(long, 8, 16)
    assert (h[1 : at[2]].tolist(), pos[1 : at[2]].tolist()) == want and h[at[2] :].tolist() == want[0] and at[1] == 1
    docs = spark.createDataFrame([(1, long), (1, long), (2, "Short one!"), (3, "short... ONE"), (4, "_ !")], "doc_id long, text string")
    got = [(r.doc_id, tuple(r.hashes), tuple(r.positions)) for r in winnow.fingerprinted(docs).collect()]
    assert len(got) == 5 and got.count(next(x for x in got if x[0] == 1)) == 2
    by = {i: (x, p) for i, x, p in got}
    assert by[2][0] == by[3][0] and len(by[2][0]) == 1 and by[4] == ((), ())


def test_winnow_guarantee(spark):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefghij") for _ in range(winnow.K + winnow.WINDOW - 1))
    noise = lambda: "".join(rng.choice("klmnopqrst ") for _ in range(700))
    rows = [(1, noise() + shared + noise()), (2, noise() + shared.upper() + noise()), (3, noise()), (None, None), (5, "")]
    got = {r.doc_id: r for r in winnow.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hashes", F.lit("clash"))).collect()}
    assert set(got[1].hashes) & set(got[2].hashes) and not set(got[1].hashes) & set(got[3].hashes)
    assert got[None].hashes == [] and got[5].positions == []
    assert winnow.fingerprinted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- language


def brute_phrases(train, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def norm(text):
    return "".join(map(chr, langid.normalised([text])[0]))


def test_cross_parsing_is_brute_force():
    rng = random.Random(2)
    train = ["the cat and the hat sat on that mat", "die katze und der hut auf der matte"]
    texts = ["", "a", "the hat", "katze katze", "zzz qqq"] + ["".join(rng.choice("thecaduik ") for _ in range(rng.randrange(90))) for _ in range(50)]
    model = langid.Model((("en", train[0]), ("de", train[1])))
    got, lengths = model.phrases(texts, 10_000)
    for i, t in enumerate(texts):
        n = norm(t)
        assert lengths[i] == len(n)
        assert got[i].tolist() == [brute_phrases(x, n) for x in train], t
    for block in (1, 2, 16):
        assert model.phrases(texts, block)[0].tolist() == got.tolist()


def test_blocks_go_on_from_one_another():
    """Texts that repeat the training text never end a phrase within a block, so that corrections pass on from block to block."""
    rng = random.Random(11)
    train = "".join(rng.choice("abcde ") for _ in range(600))
    texts = [train, train[100:] + train, "x" * 200, "".join(rng.choice("abcdx ") for _ in range(900)), train[3:300] + "q" + train[20:200]]
    model = langid.Model((("x", train), ("y", train[::-1])))
    want = [[brute_phrases(t, norm(text)) for t in (norm(train), norm(train[::-1]))] for text in texts]
    assert want[0][0] == 1
    for block in (1, 7, 64, 256, 5000):
        assert model.phrases(texts, block)[0].tolist() == want


EN = "the quick brown fox jumps over the lazy dog while many people were watching from their houses near the river and talking about it for hours "
DE = "der schnelle braune fuchs springt ueber den faulen hund waehrend viele leute aus ihren haeusern am fluss zusahen und stundenlang darueber sprachen "


def test_languages_and_rejection(spark):
    rng = random.Random(3)
    mix = lambda s: " ".join(rng.sample(s.split(), len(s.split())))
    rows = [(i, mix(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(40)]
    odd = [(100 + i, t, None) for i, t in enumerate(ODD)] + [(200, mix(EN), "de"), (201, "qwx zzkj vvbq xjq " * 20, "en"), (None, mix(DE), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("language", F.lit(1)).withColumn("keep", F.lit("?"))
    samples, limit = langid.training(docs.where("doc_id < 100"), held=10, most=10)
    got = {r.doc_id: r for r in langid.identified(docs, samples, limit).collect()}
    assert all(got[i].language == lang and got[i].keep for i, _, lang in rows)
    assert got[200].language == "en" and got[None].language == "de"
    assert got[201].keep is False
    for i, t in enumerate(ODD):
        if not any(c.isalpha() for c in t or ""):
            assert got[100 + i].language == "und" and not got[100 + i].keep
    kept = langid.accepted(docs, samples, limit)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    empty = docs.limit(0)
    assert langid.training(empty) == ((), langid.Limit()) and langid.identified(empty, (), langid.Limit()).count() == 0
    assert {r.language for r in langid.identified(docs, (), langid.Limit()).collect()} == {"und"}


def test_languages_of_long_documents(spark):
    rng = random.Random(5)
    mix = lambda s, k: " ".join(rng.choice(s.split()) for _ in range(k))
    en = [(i, mix(EN, 60), "en") for i in range(20)]
    de = [(100 + i, mix(DE, 1500), "de") for i in range(8)]
    assert min(len(t) for _, t, _ in de) > langid.TRAIN_CHARS // 5
    for rows in (en + de, de + [(200 + i, mix(EN, 1500), "en") for i in range(8)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        samples, limit = langid.training(docs)
        assert [lang for lang, _ in samples] == ["de", "en"] and len(samples[0][1]) >= langid.TRAIN_CHARS and limit.bits < math.inf
        assert all(r.language == r.lang and r.keep for r in langid.identified(docs, samples, limit).collect())
    # short ones come first, longer ones fill up
    both = spark.createDataFrame([(1, "lang " * 1500, "x"), (2, "kurz", "x"), (3, "lang " * 1400, "x")], "doc_id long, text string, lang string")
    assert langid.training(both, held=0)[0] == (("x", " ".join(["kurz", "lang " * 1400, "lang " * 1500])),)


def test_few_labels_and_ties(spark):
    rng = random.Random(9)
    mix = lambda s: " ".join(rng.sample(s.split(), len(s.split())))
    odd = [(900, "qwx zzkj vvbq xjq " * 20, None), (901, "zq", None), (902, mix(EN), None)]
    # two documents of a language are enough to hold one out
    docs = spark.createDataFrame([(1, mix(EN), "en"), (2, mix(EN), "en"), (3, mix(DE), "de"), (4, mix(DE), "de"), *odd], "doc_id long, text string, lang string")
    samples, limit = langid.training(docs)
    got = {r.doc_id: r for r in langid.identified(docs, samples, limit).collect()}
    assert limit.bits < math.inf and not got[900].keep and all(got[i].keep for i in (1, 2, 3, 4, 901, 902)) and got[902].language == "en"
    # one document of each leaves nothing to hold out, one language nothing to compare with
    for few in (docs.where("doc_id in (1, 3) or lang is null"), docs.where("lang = 'en' or lang is null")):
        samples, limit = langid.training(few)
        assert samples and limit == langid.Limit() and all(r.keep for r in langid.identified(few, samples, limit).collect())
    # equal scores: the first in alphabetical order
    same = spark.createDataFrame([(i, EN, x) for i, x in enumerate(("zz", "aa", "mm"))], "doc_id long, text string, lang string")
    assert {r.language for r in langid.identified(same, *langid.training(same)).collect()} == {"aa"}


def test_limit_widens_for_short_texts():
    limit = langid.Limit(2.0, 1.0)
    at = 2.0 + langid.SIGMAS / np.sqrt(np.array([10, 100]))
    assert limit.keeps(at - 0.01, np.array([10, 100])).all() and not limit.keeps(at + 0.01, np.array([10, 100])).any() and at[0] > at[1]
    assert langid.Limit().keeps(np.array([99.0]), np.array([10**6])).all()


# -- benchmark


def brute_spans(text_words, items, min_words, cover, floor):
    """Leaked spans (first word, end, item), by trying every run of the text in every run of every item."""
    n, found = len(text_words), []
    for i in range(n):
        for j in range(i + floor, n + 1):
            run = text_words[i:j]
            for k, item in enumerate(items):
                if any(item[x : x + j - i] == run for x in range(len(item) - (j - i) + 1)) and (j - i >= min_words or j - i >= cover * len(item)):
                    found.append((i, j, (len(item), k)))
    out = []
    for i, j, item in sorted(found):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j), min(out[-1][2], item))
        else:
            out.append((i, j, item))
    return [(i, j, item[1]) for i, j, item in out]


def spans_of(text, auto):
    """The spans in words of a text whose words are single letters."""
    return [(text[:a].count(" "), text[:a].count(" ") + n, item) for _, _, spans, _ in decontaminate.leaked([text], auto) for a, b, n, item in spans]


@pytest.mark.parametrize("seed", range(100))
def test_leaks_are_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = "abcdef"[: rng.choice([2, 3, 6])]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 14))] for _ in range(rng.randrange(1, 6))]
    items.append(items[0][1:])
    auto = decontaminate.Automaton([(i, " ".join(x)) for i, x in enumerate(items)], 3, 6, 0.8)
    for _ in range(5):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))] + rng.choice(items)
        assert spans_of(" ".join(text), auto) == brute_spans(text, items, 6, 0.8, 3)


def test_short_item_within_a_longer_match():
    """Seven words of the long item are too few of it, but they begin with, or end in, the whole of the short one."""
    long = "p q r s t u v " + " ".join("abcdefghijklm")
    for text, short, want in (("x p q r s t u v x", "r s t u v", (3, 8)), ("x p q r s t u v x", "p q r s t", (1, 6)), ("x p q r s t u v x", "q r s t u", (2, 7))):
        auto = decontaminate.Automaton([(1, long), (2, short)], 5, 8, 0.8)
        assert spans_of(text, auto) == [(*want, 2)]


def test_cleaned(spark):
    item = "what is the boiling point of water at sea level in degrees"
    other = "seven short words stand in this item"
    clean = "nothing of the kind is said here about any boiling thing"
    rows = [
        (1, f"Before it. {item.upper()}! After it comes more text and yet more text of our own.", 5), (2, item, None), (3, clean, 7), (4, f"{other}", 0), (5, None, None), (6, "", 0), (7, "long " * 20_000 + item + " end" * 20_000, 1), (None, clean, 1), (3, clean, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("clash"))
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "tiny one"), (None, "")], "item_id long, text string")
    out = decontaminate.cleaned(docs, bench)
    assert out.schema == docs.schema
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    by = {i: t for i, t, _ in got}
    assert by[1] == "Before it. ! After it comes more text and yet more text of our own." and (1, by[1], len(by[1])) in got
    assert 2 not in by and 4 not in by and by[5] is None and by[6] == "" and got.count((3, clean, 7)) == 2 and by[None] == clean
    assert "boiling" not in by[7] and by[7].startswith("long long") and by[7].endswith("end")
    found = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {1, 2, 4, 7} and found[2].dropped and not found[1].dropped and found[4].spans[0].item_id == 2
    parts = decontaminate.cleaned(docs, bench, part_words=1)
    assert sorted(map(str, parts.collect())) == sorted(map(str, out.collect()))
    assert decontaminate.cleaned(docs, bench.limit(0)).count() == len(rows) and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.cleaned(docs.limit(0), bench).count() == 0


def test_parts_of_a_benchmark_are_one(spark):
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    first, second = (" ".join(f"{c}{i}" for i in range(35)) for c in "xy")
    items = [(i, draw(rng.randrange(2, 14))) for i in range(8)] + [(None, "a b c d e f a b c"), (20, first), (21, second), (22, "p q r s t u"), (23, "p q r s t u v " + draw(40))]
    rows = [(i, draw(60)) for i in range(40)] + [(100, f"{first} {second} " + "own " * 30), (101, f"p q r s t u v {draw(9)}"), (100, None), (None, f"own {first} own"), (None, f"own {first} own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__found", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in (decontaminate.leaks, decontaminate.cleaned):
        one, several = (how(docs, bench, min_words=7, floor=3, part_words=n) for n in (1000, 1))
        assert several.schema == one.schema and sorted(map(str, several.collect())) == sorted(map(str, one.collect()))
    found = [r for r in decontaminate.leaks(docs.where("doc_id = 100"), bench, part_words=1).collect()]
    assert [(r.leaked_words, r.words, r.dropped, r.clean_text) for r in found] == [(70, 100, True, " ".join(["own"] * 30))]
    assert decontaminate.cleaned(docs.where("doc_id = 100 and text is not null"), bench, part_words=1).count() == 0


# -- quality


def corpus(n, seed):
    rng = random.Random(seed)
    good = "the river ran quietly past old houses where people sat and told each other long stories about winter".split()
    texts, q, t = [], [], []
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        toxic, bad = i % 5 == 0, i % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scumbag", "loser", "grumpf" + rng.choice("abcdefgh")])
        s = " ".join(w)
        if bad:
            s = rng.choice(["BUY NOW!!! | ", "click | here | ", "$$$ "]) * 5 + s.upper()
        texts.append(s)
        q.append(0.0 if bad else 1.0)
        t.append(1.0 if toxic else 0.0)
    return texts, np.array(q), np.array(t)


def test_quality_on_held_out_texts():
    texts, q, t = corpus(600, 1)
    model = quality.train(texts, q, t)
    held, hq, ht = corpus(300, 2)
    good, toxic = model.scores(held)
    assert ((good >= 0.5) == (hq == 1)).mean() > 0.97 and ((toxic >= 0.5) == (ht == 1)).mean() > 0.97


def test_scores_are_sums_of_tables():
    texts, q, t = corpus(200, 3)
    model = quality.train(texts, q, t)
    x = quality.features(texts[:20], model.toxic_words, model.bad_words, model.toxic_beginnings)
    m = model.quality
    for row, s in zip(x, m.score(x)):
        z = m.intercept + sum(tab[int((e <= v).sum())] for e, tab, v in zip(m.edges, m.tables, row))
        z += sum(tab[int((m.pair_edges[i] <= row[i]).sum()), int((m.pair_edges[j] <= row[j]).sum())] for i, j, tab in m.pairs)
        assert s == pytest.approx(1 / (1 + math.exp(-z)))
    one = np.concatenate([quality.features([x], model.toxic_words, model.bad_words, model.toxic_beginnings) for x in texts[:20]])
    assert np.allclose(one, x)


def test_cuts_are_brute_force():
    rng = np.random.default_rng(3)
    score = lambda g, h: g.sum() ** 2 / (h.sum() + 1.0)
    for _ in range(60):
        n, m = rng.integers(2, 9, 2)
        g, h = rng.normal(size=n), rng.random(n)
        parts = [(0, int(n))]
        for leaves in (2, 3, 4):  # best first: the cut that gains most in any part, if it gains at all
            cuts = [(score(g[a:k], h[a:k]) + score(g[k:b], h[k:b]) - score(g[a:b], h[a:b]), a, k, b) for a, b in parts for k in range(a + 1, b)]
            gain, a, k, b = max(cuts, default=(0, 0, 0, 0))
            if gain > 1e-12:
                parts = sorted({*parts} - {(a, b)} | {(a, k), (k, b)})
            want = np.concatenate([np.full(b - a, -g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in parts])
            assert np.allclose(quality._tree(g, h, leaves), want)
        g, h = rng.normal(size=(n, m)), rng.random((n, m))
        quads = lambda a, b: [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, m)), (slice(a, n), slice(0, b)), (slice(a, n), slice(b, m))]  # noqa: B023, E731
        gain, a, b = max((sum(score(g[q], h[q]) for q in quads(a, b)) - score(g, h), a, b) for a in range(1, n) for b in range(1, m))
        got, values = quality._quad(g, h)
        assert np.isclose(got, gain) and all(np.allclose(values[q], -g[q].sum() / (h[q].sum() + 1)) for q in quads(a, b))


def test_sample_is_bounded(spark):
    """One labelled id with any number of rows and texts gives no more than asked for."""
    docs = spark.createDataFrame([(1, "same")] * 300 + [(1, f"text {i}") for i in range(300)] + [(2, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    texts, q, t = quality.labelled(docs, labels, most=20)
    assert len(texts) == len(set(texts)) == 20 and len(q) == len(t) == 20
    assert sorted(quality.labelled(docs, labels)[0]) == sorted({"same", "x", *(f"text {i}" for i in range(300))})
    assert quality.labelled(docs, labels.limit(0))[0] == []


def test_quality_edges(spark):
    texts, q, t = corpus(60, 4)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(100 + i, x) for i, x in enumerate(ODD)] + [(None, "x y"), (1, texts[1])], "doc_id long, text string").withColumn("quality", F.lit("clash")).withColumn("toxic", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(q, t))] + [(3, None, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(*quality.labelled(docs, labels))
    got = quality.scored(docs, model).collect()
    assert len(got) == len(texts) + len(ODD) + 2 and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 and r.keep is not None for r in got)
    blank = {(r.quality, r.toxic) for r in got if r.doc_id in (100, 101)}
    assert len(blank) == 1
    none = quality.train(*quality.labelled(docs, labels.limit(0)))
    assert {(round(r.quality, 6), round(r.toxic, 6)) for r in quality.scored(docs, none).collect()} == {(0.5, 0.5)}
    assert quality.scored(docs.limit(0), model).count() == 0
    one_class = quality.train(*quality.labelled(docs, labels.where("quality = 1")))
    assert all(r.quality > 0.9 for r in quality.scored(docs, one_class).collect())
