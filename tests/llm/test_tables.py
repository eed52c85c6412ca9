"""Operators on whole tables: against brute force, SQL and round trips."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strataspark.llm import files, html, minhash, mixing, sharding, store, urls, warc
from strataspark.llm.textvec import Words

WORDS = [a + b for a in "ka me so tu ri lo ne".split() for b in "ban dor fil gam hes jun kel lim".split()]


def make(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def near(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


def shingles(text, k=minhash.K):
    w = [x.lower() for x in text.split()]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups_of(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def brute_pairs(rows, threshold):
    sets = [(i, shingles(t)) for i, t in rows if shingles(t)]
    return {(a, b) for x, (a, s) in enumerate(sets) for b, u in sets[x + 1 :] if len(s & u) >= threshold * len(s | u)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = []
    for _ in range(60):
        base = make(rng, rng.randrange(3, 150))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            rows.append(near(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.3])))
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want = brute_pairs(corpus, minhash.THRESHOLD)
    groups = {r.doc_id: r.component for r in minhash.near_groups(docs).collect()}
    together = sum(groups[a] == groups[b] for a, b in want)
    assert len(want) > 40 and together >= 0.95 * len(want)
    closed = groups_of(want)
    wrong = [(a, b) for a in groups for b in groups if a < b and groups[a] == groups[b] and closed.get(a, a) != closed.get(b, -b - 1)]
    assert not wrong
    left = {r.doc_id for r in minhash.deduplicated(docs).collect()}
    by = {}
    for i, c in groups.items():
        by.setdefault(c, []).append(i)
    assert left == {min(v) for v in by.values()}


def test_cross_comparison_completes_groups(spark):
    """Small blocks, so that buckets are compared in several of them; all pairs are copies or nearly."""
    rng = random.Random(8)
    base = make(rng, 60)
    rows = [(i, " ".join(near(rng, base, 0.02))) for i in range(60)] + [(100 + i, " ".join(make(rng, 60))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_of(brute_pairs(rows, minhash.THRESHOLD))
    groups = {r.doc_id: r.component for r in minhash.near_groups(docs, block=7).collect()}
    assert len({groups[i] for i in range(60)}) == len({want[i] for i in range(60)}) and len({groups[100 + i] for i in range(5)}) == 5


def test_near_duplicate_edges(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(5, a), (3, a.upper() + "!"), (None, a), (7, None), (8, ""), (9, "..."), (9, "..."), (10, "solo"), (11, "Solo."), (12, "word " * 20_000), (13, "word " * 20_000), (14, "other text that is nothing like these"), (14, "other text that is nothing like these"), (15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text_hash", F.lit("mine")).withColumn("__gone_id", F.lit(1)).withColumn("component", F.lit(2))
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert [i for n, i in got if not n] == [3, 7, 8, 9, 9, 10, 12, 14, 15] and not any(n for n, _ in got)
    pairs = {(r.doc_id, r.keep_id) for r in minhash.duplicates(docs).collect()}
    assert pairs == {(5, 3), (None, 3), (11, 10), (13, 12)}
    assert minhash.deduplicated(docs.limit(0)).count() == 0 and minhash.duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_document(spark):
    """Equal doc_id and text, other columns differ: the least as JSON stays, in whatever order they come."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b", None), (1, text, "a", [2]), (1, text, "a", [1]), (2, "solo piece of other words here", None, None), (2, "solo piece of other words here", None, None), (3, "!!", "x", None), (3, "!!", "x", None), (None, "null id with some words", "z", None), (None, "null id with some words", "y", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, extra string, list array<int>")
        out = minhash.deduplicated(docs)
        assert out.schema == docs.schema
        assert sorted(map(str, ((r.doc_id, r.extra, r.list) for r in out.collect()))) == sorted(map(str, [(1, "a", [1]), (2, None, None), (3, "x", None), (3, "x", None), (None, "y", None)]))


def test_nothing_is_left_behind(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert minhash.near_groups(spark.createDataFrame(corpus, "doc_id long, text string")).count() == len(corpus)
    assert [p.name.split("-")[0] for p in (tmp_path / "strataspark").iterdir()] == ["groups"]


def test_posterior_bounds():
    least = minhash.least_matches(0.55, 0.005, 128, 16)
    assert len(least) == 8 and list(least) == sorted(least)
    rng = np.random.default_rng(0)
    for s in (0.55, 0.6, 0.8):
        a = rng.integers(0, 256, (4000, 128), dtype=np.uint8)
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        alive, equal = minhash.passes(a, b, least, 16)
        assert len(alive) >= (0.93 if s == 0.55 else 0.985) * len(a) and (equal == (a[alive] == b[alive]).sum(axis=1)).all()
    far = rng.integers(0, 256, (4000, 128), dtype=np.uint8)
    assert len(minhash.passes(a, far, least, 16)[0]) == 0


def test_minhash_estimates_similarity():
    rng = random.Random(9)
    base = make(rng, 400)
    texts = [" ".join(base), " ".join(near(rng, base, 0.1))]
    sh, first = Words(texts).shingles(3)
    values = minhash.minhashes(sh, first, 512)
    x, y = (shingles(t) for t in texts)
    assert abs((values[0] == values[1]).mean() - len(x & y) / len(x | y)) < 0.08


# -- sharding and mixing


def frame(spark, seed=11, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "b", "c", None]), " ".join(["w"] * rng.randrange(0, 12))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def against(sql, docs, got):
    documents = docs.toPandas()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    have = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(map(str, want)) == sorted(map(str, have)), names


def test_sharding_is_the_sql(spark):
    docs = frame(spark)
    against(sharding.OP3_SQL, docs, sharding.sharded(docs).select("doc_id", "source", "position", "shard"))


def test_shards_match_the_mixture(spark):
    docs = frame(spark).withColumn("__g", F.lit("x")).withColumn("__before", F.lit(1)).withColumn("shard", F.lit("old"))
    out = sharding.sharded(docs, 8)
    assert set(out.columns) == {*docs.columns, "position"}
    rows = out.collect()
    assert sorted(r.position for r in rows) == list(range(1, len(rows) + 1)) and all(r["__g"] == "x" for r in rows)
    total = {s: sum(r.source == s for r in rows) for s in ("a", "b", "c", None)}
    for k in range(8):
        own = [r for r in rows if r.shard == k]
        assert len(own) == 50
        for s, n in total.items():
            assert abs(sum(r.source == s for r in own) - n / 8) <= 2


def test_shards_lie_in_contiguous_files(spark, tmp_path):
    """Rows are written in order of position, so that a folder a shard takes no further shuffle."""
    docs = frame(spark)
    sharding.sharded(docs, 8).write.partitionBy("shard").parquet(f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").withColumn("f", F.col("_metadata.file_path")).groupBy("f").agg(F.count("*").alias("n"), F.max("position").alias("z"), F.min("position").alias("a"), F.countDistinct("shard").alias("s")).collect()
    assert all(r.z - r.a + 1 == r.n and r.s == 1 for r in back) and sum(r.n for r in back) == docs.count()


def test_each_document_its_own_source(spark):
    docs = spark.createDataFrame([(i, f"domain{i % 300}.org" if i < 400 else "hot", "w") for i in range(600)], "doc_id long, source string, text string")
    against(sharding.OP3_SQL, docs, sharding.sharded(docs).select("doc_id", "source", "position", "shard"))


def test_sharding_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "s", None), (2, "s", "")], "doc_id long, source string, text string")
    assert sorted(r.position for r in sharding.sharded(docs, 3).collect()) == [1, 2, 3, 4]
    assert sharding.sharded(docs.limit(0)).count() == 0 and "shard" in sharding.sharded(docs.limit(0)).columns


def test_mixing_is_the_sql(spark):
    docs = frame(spark, 12)
    against(mixing.OP5_SQL, docs, mixing.in_order(mixing.mixed(docs)).select("doc_id", "source", "n_tokens", "epoch", "position"))


def test_curriculum_is_followed(spark):
    rng = random.Random(13)
    docs = spark.createDataFrame([(i, "ab"[i % 2], " ".join(["w"] * rng.randrange(1, 20))) for i in range(2000)], "doc_id long, source string, text string")
    schedule = {"a": [(0.0, 0.9), (1.0, 0.1)], "b": [(0.0, 0.1), (1.0, 0.9)]}
    rows = mixing.mixed(docs.withColumn("__held", F.lit(0)).withColumn("position", F.lit("old")), schedule, budget=12_000).collect()
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in rows if lo <= r.position < lo + 0.25]
        tokens = sum(r.n_tokens for r in part)
        share = sum(r.n_tokens for r in part if r.source == "a") / tokens
        assert abs(share - (0.9 - 0.8 * (lo + 0.125))) < 0.03 and abs(tokens - 3000) < 90
    ordered = [r.position for r in mixing.in_order(mixing.mixed(docs, schedule, budget=12_000), partitions=4).collect()]
    assert ordered == sorted(ordered)
    scarce = mixing.mixed(docs, {"a": [(0.0, 1.0)], "b": [(0.0, 0.0)]}, budget=40_000).collect()
    assert {r.source for r in scarce} == {"a"} and max(r.epoch for r in scarce) == 3
    # position is where the integrated demand reaches the tokens before the document
    one = sorted((r for r in rows if r.source == "b"), key=lambda r: r.position)
    before = 0
    for r in one[:200]:
        assert 12_000 * (0.1 * r.position + 0.8 * r.position**2 / 2) == pytest.approx(before, abs=0.01)
        before += r.n_tokens


def test_capped_source_lasts(spark):
    rows = [(i, "tiny", "w") for i in range(10)] + [(100 + i, "abcde"[i % 5], "w " * 100) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    tiny = sorted(r.position for r in got if r.source == "tiny")
    assert len(tiny) == 4 * 10 and {r.epoch for r in got if r.source == "tiny"} == {0, 1, 2, 3} and 0.95 < tiny[-1] < 1
    (_, x), (_, y) = mixing.default_schedule({"tiny": 10, **dict.fromkeys("abcde", 20_000)})["tiny"]
    for need, t in enumerate(tiny):
        assert 40 * (x * t + (y - x) * t * t / 2) / ((x + y) / 2) == pytest.approx(need, abs=0.001)
    for q in range(4):  # the others fill up
        assert abs(sum(r.n_tokens for r in got if q / 4 <= r.position < q / 4 + 0.25) - 100_010 / 4) <= 600
    # one that is lifted over its own limit is lowered in turn; the weights add up to 1
    knots = {"a": [(0.0, 0.6), (1.0, 0.2)], "b": [(0.0, 0.1), (1.0, 0.3)], "c": [(0.0, 0.3), (1.0, 0.5)]}
    parts = mixing.segments(knots, 100.0, {"a": 10.0, "b": 21.0})
    assert {s: round(50 * (x + x + rise), 9) for s, _, _, x, rise, _ in parts} == {"a": 10, "b": 21, "c": 69}
    assert sum(p[3] for p in parts) == pytest.approx(1) and sum(p[3] + p[4] for p in parts) == pytest.approx(1)


def test_equal_positions_come_by_source_and_hash(spark):
    placed = spark.createDataFrame([(i, "ab"[i % 2], i % 3, 0.5) for i in range(60)], "doc_id long, source string, epoch int, position double")
    got = [(r.source, r.h, r.epoch) for r in mixing.in_order(placed, partitions=1).withColumn("h", sharding.seeded(mixing.SEED)).collect()]
    assert got == sorted(got)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x y"), (1, None, "x y"), (None, "s", "a"), (2, "s", ""), (3, "s", None), (4, "s", "w " * 50_000)], "doc_id long, source string, text string")
    assert mixing.mixed(docs).columns == [*docs.columns, *mixing.ADDED]
    rows = mixing.mixed(docs).collect()
    assert {r.doc_id for r in rows} <= {1, None, 4} and sum(r.doc_id == 4 for r in rows) >= 1 and all(0 <= r.position <= 1 for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("doc_id in (2, 3)")).count() == 0


# -- pages


def page(rng, body):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in make(rng, rng.randrange(3, 9)))
    foot = "".join(f"<span>{w}</span>" for w in make(rng, 4))
    return f"<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav><ul>{nav}</ul></nav>{body}<footer>{foot}</footer></body></html>"


def body(rng, mark):
    text = "".join(f"<p>{' '.join(make(rng, rng.randrange(20, 50)))}.</p>" for _ in range(rng.randrange(1, 4)))
    return f"<{mark}>{text}</{mark}>", text


def test_best_region_is_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = rng.integers(-4, 5, rng.integers(0, 14)).astype(float)
        best = max(((w[a:b].sum(), -b, a) for a in range(len(w)) for b in range(a + 1, len(w) + 1)), default=(0, 0, 0))
        want = (best[2], -best[1]) if best[0] > 0 else (-1, -1)
        assert html.best_region(w) == want


def test_extraction_learns_from_marked_pages(spark):
    rng = random.Random(14)
    marked = [page(rng, body(rng, "article")[0]) for _ in range(40)]
    weights = html.learn(marked)
    assert weights["#text"] > 0 and all(v > 0 for c, v in weights.items() if c[0] == "#") and all(v < 0 for c, v in weights.items() if c[0] != "#")
    hits = 0
    for _ in range(40):
        b, text = body(rng, "div")
        p = page(rng, b)
        want = " ".join(html.TOKEN.sub(lambda m: m.group() if m.group()[0] != "<" else " ", text).split())
        got, a, z, _ = html.extract(p, weights)
        hits += " ".join(got.split()) == want
        assert "var a" not in got and 0 <= a < z <= len(p)
    assert hits >= 36


def test_extraction_edges(spark):
    rows = [(1, None), (2, ""), (3, "<br><hr>"), (4, "plain &amp; simple"), (None, "<p>a<p>b"), (5, "<p>" + "long " * 50_000), (6, "<a <b <<< > x"), (6, "<a <b <<< > x"), (7, "<!-- never closed <p>x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extracted(pages, {}).collect()}
    assert [(got[i].text, got[i].start_char) for i in (1, 2, 3, 7)] == [("", -1)] * 4 and got[4].text == "plain & simple" and len(got[5].text) == 5 * 50_000 - 1
    assert html.extracted(pages, {}).count() == len(rows) and html.extracted(pages.limit(0), {}).count() == 0 and html.learn([]) == {}


@pytest.mark.parametrize(
    "page_,text",
    [
        ("<p title=it's>alpha", "alpha"), ('<p title=5">alpha beta</p>', "alpha beta"), ('<a href="x>y">k</a>', "k"), ("<p a= 'q>r'>s", "s"), ("<p a='b>c", "c"), ("<img alt=a<b>c", "c"), ("x <y and no end", "x"), ("a < b", "a < b"), ("</ >t", "t"), ("t <!doctype", "t"),
    ],
)
def test_no_part_of_a_tag_is_text(page_, text):
    assert html.extract(page_, {})[0] == text


def test_labelled_pages_are_those_of_least_hash(spark):
    rows = [(i % 50 if i % 7 else None, f"<main>{i}</main>" if i % 3 else f"<p>{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    marked = sorted((r.h, r.page_id is not None, r.page_id or 0, r.html) for r in pages.withColumn("h", F.xxhash64("page_id")).collect() if "<main>" in r.html)
    for most in (1, 10, 60, 1000):
        assert html.labelled_pages(pages, most) == [x[3] for x in marked[:most]]
    assert html.labelled_pages(pages.limit(0)) == []


def test_url_filter(spark, monkeypatch):
    blocked = ["bad.example.com", "site.org/secret/page", "site.org/q?x=1", "", None, " bad.example.com ", "naïve.org/ü"]
    urls_ = {
        "http://bad.example.com/x": "bad.example.com", "https://sub.BAD.example.com:8080/": "bad.example.com", "http://user@site.org/secret/page#frag": "site.org/secret/page", "http://site.org/secret/page?y=2": "site.org/secret/page",
        "http://site.org/q?x=1": "site.org/q?x=1", "http://site.org/q?x=2": None, "http://notbad.example.com/": None, "http://example.com": None, "": None, "  ": None, "site.org": None, "http://naïve.org/ü": "naïve.org/ü", "http://" + "a" * 50_000 + ".com/": None,
    }
    rows = [(i, u) for i, u in enumerate(urls_)] + [(None, None), (0, "http://bad.example.com/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("entry", F.lit("clash"))
    block = spark.createDataFrame([(b,) for b in blocked], "u string")
    for file_entries in (1_000_000, 2):
        got = urls.filtered(pages, block, file_entries=file_entries).collect()
        assert len(got) == len(rows)
        for r in got:
            want = urls_.get(r.url)
            assert (r.blocked, r.entry) == (want is not None, want), r
    assert not any(r.blocked for r in urls.filtered(pages, block.limit(0)).collect()) and urls.filtered(pages.limit(0), block).count() == 0


def test_blocklist_has_domains_and_urls(spark, tmp_path):
    rows = [(1, "http://m.casino-win.example.com/de/1"), (2, "http://SPAM-farm.example.org:80/x?y=1"), (3, "http://good.example.com/de/7.html"), (4, "http://good.example.com/de/8"), (5, "http://nocasino-win.example.com/9"), (6, "http://good.example.com/de/10")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.entry for r in urls.op6_urls_domains(spark, str(tmp_path)).collect()}
    assert got == {1: "casino-win.example.com", 2: "spam-farm.example.org", 3: "good.example.com/de/7.html", 4: None, 5: None, 6: None}


def test_colliding_digests_are_told_apart(tmp_path):
    key, asked = np.array([7, 7, 7], np.int64), (pa.array(["x", "other"]), np.array([1, 7], np.int64))
    data = [b"one", b"two", b"three"]
    base = f"file://{tmp_path}/000000"
    files.write(f"{base}.keys", key.tobytes())
    files.write(f"{base}.ends", np.cumsum([0, *map(len, data)]).astype(np.int64).tobytes())
    files.write(f"{base}.text", b"".join(data))
    assert urls.Probe(f"file://{tmp_path}", 0, [0]).has(*asked).tolist() == []
    files.array.cache_clear()
    files.write(f"{base}.text", b"".join([*data[:2], b"other"]))
    assert urls.Probe(f"file://{tmp_path}", 0, [0]).has(*asked).tolist() == [1]


def test_forms_of_urls(spark):
    want = {"a.b.c/p?q": ["a.b.c/p?q", "a.b.c/p", "a.b.c", "b.c"], "a.b/": ["a.b/", "a.b"], "localhost/x": ["localhost/x", "localhost"], "w.x.y.z/": ["w.x.y.z/", "w.x.y.z", "x.y.z", "y.z"], "a..b/": ["a..b/", "a..b", ".b"], None: None}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", urls.candidates("u").alias("f")).collect()
    assert {r.u: r.f for r in got} == want


def test_warc_round_trip(spark):
    rng = random.Random(15)
    rows = [(i, f"http://h.org/{i}", page(rng, body(rng, "div")[0])) for i in range(300)] + [(None, None, None), (300, "http://x.org/a b\r\nEvil: 1", ""), (301, None, "é" * 40_000), (0, "http://h.org/0", rows0 := "same"), (0, "http://h.org/0", rows0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = store.fresh_path(spark, "warc-test")
    places = warc.written(pages, path, file_bytes=100_000)
    back = warc.read(spark, path).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.html) for r in back) == sorted((i is None, i or 0, h or "") for i, _, h in rows)
    by = {(r.file.rsplit("/", 1)[-1], r.offset): r for r in back}
    got = places.collect()
    assert len(got) == len(rows) and len(by) == len(rows)
    for r in got:
        data = files.read(r.file)
        trained, _ = warc.dictionary_of(data)
        one = zstandard.ZstdDecompressor(dict_data=trained).decompress(data[r.offset : r.offset + r.length])
        head, content = warc.parse(one)
        assert head["WARC-Type"] == "resource" and "Evil" not in head and by[r.file.rsplit("/", 1)[-1], r.offset].html == content.decode()
    assert sum(r.length for r in got) < 0.75 * sum(len(zstandard.ZstdCompressor(level=3).compress((h or "").encode())) for _, _, h in rows)
    assert warc.written(pages.limit(0), store.fresh_path(spark, "warc-none")).count() == 0


def test_unpacking_is_linear():
    """Frames of all kinds: raw, repeated and compressed blocks, several blocks, empty and with a window."""
    rng = random.Random(16)
    records = [b"", b"a", b"z" * 500_000, rng.randbytes(400_000), b" ".join(w.encode() for w in make(rng, 60_000))] + [page(rng, body(rng, "div")[0]).encode() for _ in range(300)]
    data, places = warc.pack(records)
    got = list(warc.unpack(data))
    assert [c for _, c in got] == records and [a for a, _ in got] == [a for a, _ in places] and all(warc.frame_end(data, a) == a + n for a, n in places)
    for kw in ({"write_content_size": False}, {"write_checksum": True}, {"level": 19}):
        frame = zstandard.ZstdCompressor(**kw).compress(records[4])
        assert warc.frame_end(b"..." + frame + b"...", 3) == 3 + len(frame)
    many, _ = warc.pack([b"record %d" % i for i in range(50_000)])
    assert sum(1 for _ in warc.unpack(many)) == 50_000


def test_schemes_of_side_files():
    assert files.local("dbfs:/a/b") == "/dbfs/a/b" and files.local("file:///a") == "/a" and files.local("/a") == "/a" and files.local("s3a://b/c") is None
    system, at = files.opened("s3a://bucket/some/key?region=eu-west-1")
    assert system.type_name == "s3" and at == "bucket/some/key"


def test_tiny_warc_has_no_dictionary():
    data, places = warc.pack([b"abc"])
    assert warc.dictionary_of(data)[0] is None and [c for _, c in warc.unpack(data)] == [b"abc"] and len(places) == 1
