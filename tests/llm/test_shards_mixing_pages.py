"""Ring shards, mixing, main text and the pipeline."""

import time
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import main_text, mixing, ring


def test_ring_shards(spark):
    rows = corpus.texts(9) + [(77, "again")] * 2500
    got = ring.bounded_shards(corpus.frame(spark, rows), 7).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    again = ring.bounded_shards(corpus.frame(spark, rows, 1), 7).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in got)
    assert ring.bounded_shards(corpus.frame(spark, []).limit(0)).count() == 0


def test_ring_splits_one_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ring, "CELLS", 4)
    rows = [(None, f"text {i}") for i in range(3000)] + [(i, "x") for i in range(3000)]
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), type(spark.range(1))
    window = frame.withColumn

    def noted(self, name, column):
        if name == "first":
            seen.append(self.groupBy("arc", "cell").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).collect())
        return window(self, name, column)

    monkeypatch.setattr(frame, "withColumn", noted)
    got = ring.bounded_shards(docs, 7, virtual=8).collect()
    assert sum(r.m for r in seen[0]) == len(rows) and max(r.n for r in seen[0]) < 300
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_ring_moves_little_with_slack(spark):
    rows = [(i, "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = {r.doc_id: r.shard for r in ring.bounded_shards(docs, 10, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in ring.bounded_shards(docs, 11, slack=0.25).collect()}
    assert max(Counter(before.values()).values()) <= 3000 * 1.25 / 10 + 1
    assert sum(before[i] != after[i] for i in before) < 0.3 * len(before)


def test_spread_against_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(50):
        owners = rng.integers(0, 4, 12)
        owners[:4] = np.arange(4)
        arcs = rng.integers(0, 9, 12)
        capacity = ring.exact_capacity(int(arcs.sum()), 4)
        given = ring.spread(arcs, owners, capacity)
        assert sum(h - low for _, low, h, _ in given) == arcs.sum()
        filled = np.bincount([s for *_, s in given], [h - low for _, low, h, _ in given], minlength=4)
        assert (filled == capacity).all()
        for arc in range(12):
            ranks = sorted(x for a, low, h, _ in given if a == arc for x in range(low, h))
            assert ranks == list(range(arcs[arc]))


def mixed_rows(n=3000):
    rng = np.random.default_rng(8)
    kinds = ["plain words here " * 20, "a | b | c | d | " * 20, "x# y* z$ w% " * 30, "short one"]
    return [
        (i, kinds[int(rng.integers(4))] + str(i), ("en", "de", None)[int(rng.integers(3))], f"s{min(int(rng.exponential(1.5)), 5)}")
        for i in range(n)
    ]


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, lang string, source string").repartition(5)
    want = {"en": 0.5, "de": 0.3, "": 0.2}
    rows = [r.asDict() for r in mixing.mix_sources(docs, {"lang": want}).collect()]
    total = sum(r["n_tokens"] for r in rows)
    share = lambda f, x, w="weight": sum(r["n_tokens"] * r[w] for r in rows if r[f] == x) / sum(r["n_tokens"] * r[w] for r in rows)
    for lang, target in want.items():
        assert share("lang", lang) == pytest.approx(target, abs=1e-3)
    plain = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) ** mixing.SOFTEN["source"] for s in {r["source"] for r in rows}}
    for s, x in plain.items():
        assert share("source", s) == pytest.approx(x / sum(plain.values()), abs=1e-3)
    assert sum(r["n_tokens"] * r["weight"] for r in rows) == pytest.approx(total, rel=1e-3)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(mixing.KEEP * total, rel=0.01)
    assert sum(r["n_tokens"] for r in rows if r["kept"]) == pytest.approx(mixing.KEEP * total, rel=0.05)
    # Against plain raking over the cells.
    cells = Counter()
    for r in rows:
        cells[(r["source"], r["lang"], r["topic"])] += r["n_tokens"]
    factor = {c: 1.0 for c in cells}
    topics = mixing.soft_targets({t: sum(n for c, n in cells.items() if c[2] == t) for t in {c[2] for c in cells}}, mixing.SOFTEN["topic"])
    targets = ({s: x / sum(plain.values()) for s, x in plain.items()}, want, topics)
    for _ in range(60):
        for k in range(3):
            for x, t in targets[k].items():
                now = sum(n * factor[c] for c, n in cells.items() if c[k] == x)
                for c in cells:
                    if c[k] == x:
                        factor[c] *= t * total / now
    for r in rows[:300]:
        assert r["weight"] == pytest.approx(factor[(r["source"], r["lang"], r["topic"])], rel=0.01)


def skewed_rows(n=6000):
    rng = np.random.default_rng(5)
    kinds = ["plain words here " * 20, "a | b | c | d | " * 20, "x# y* z$ w% " * 30]
    sources = rng.choice(["hot", "warm", "small", "tiny"], n, p=[0.6, 0.37, 0.02, 0.01])
    langs, topics = rng.choice(["en", "de", "fr"], n, p=[0.7, 0.27, 0.03]), rng.choice(3, n, p=[0.85, 0.14, 0.01])
    return [(i, kinds[t] + str(i), str(x), str(s)) for i, (s, x, t) in enumerate(zip(sources, langs, topics, strict=True))]


@pytest.mark.parametrize("keep, source", [(0.8, None), (0.3, None), (0.3, {"hot": 0.5, "warm": 0.46, "small": 0.03, "tiny": 0.01})])
def test_kept_tokens_meet_targets(spark, keep, source):
    docs = spark.createDataFrame(skewed_rows(), "doc_id long, text string, lang string, source string").repartition(5)
    rows = [r.asDict() for r in mixing.mix_sources(docs, source and {"source": source}, keep).collect()]
    total = sum(r["n_tokens"] for r in rows)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    for f in ("source", "lang", "topic"):
        there = {x: sum(r["n_tokens"] for r in rows if r[f] == x) for x in {r[f] for r in rows}}
        want = source if source and f == "source" else mixing.soft_targets(there, mixing.SOFTEN[f])
        level, have = keep * total, dict(there)
        for _ in range(50):  # what a group cannot give, the others give in proportion
            level *= keep * total / sum(min(have[x], level * want[x]) for x in have)
        for x in have:
            reach = min(have[x], level * want[x])
            assert sum(r["n_tokens"] * r["probability"] for r in rows if r[f] == x) == pytest.approx(reach, rel=0.01), (f, x)
            assert sum(r["n_tokens"] for r in rows if r[f] == x and r["kept"]) == pytest.approx(reach, rel=0.25, abs=0.003 * total)


def test_bounded_factors():
    n, x, group = np.array([4.0, 6.0, 10.0, 5.0, 0.0]), np.array([8.0, 1.0, 0.5, 2.0, 1.0]), np.array([0, 0, 0, 1, 2])
    f = mixing.bounded_factors(n, x, group, np.array([12.0, 9.0, 0.0]))
    assert (n * np.minimum(1, f[group] * x))[:3].sum() == pytest.approx(12) and f[1] == mixing.TOP and f[2] == 1


def test_topic_of_capitals(spark):
    texts = {"caps": "BREAKING NEWS OF the DAY " * 20, "prose": "Breaking News of the Day " * 20, "shout": "What a day! " * 30}
    docs = spark.createDataFrame(list(texts.items()), "want string, text string")
    assert {r.want: r.got for r in docs.select("want", mixing.topic_of(F.col("text")).alias("got")).collect()} == {x: x for x in texts}


def test_mixing_edge_cases(spark):
    rows = corpus.texts(5)
    assert mixing.mix_sources(corpus.frame(spark, rows)).count() == len(rows)
    assert mixing.mix_sources(corpus.frame(spark, []).limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.n_tokens for r in mixing.mix_sources(empty).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>Title here</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><p>Site name</p></header><nav><ul><li><a href="/a">one</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy   this now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>First   para&shy;graph</b>
of the text with enough words that it is not in doubt at all &lt;b&gt;.<br>After the break.<p>Short.</p>
<p hidden>Hidden text that nobody sees in the page at all, long enough to be a real block of text.</p>
<ul><li>Item one</li><li>Item two</li></ul><form><label>Name</label><input></form>
<p><a href="x">More</a> <a href="y">links</a> <a href="z">only</a></p>
<aside><p>Side story that is long enough to look like text of the article in every way there is.</p></aside></article>
<section class="comments"><p>I think that this is a very good article and that all of you should read it.</p></section>
<footer>&copy; 2020 &middot; All rights</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE).split("\n\n") == [
        "Head & line",
        "First para­graph of the text with enough words that it is not in doubt at all <b>. After the break.",
        "Short.",
        "Item one",
        "Item two",
    ]


LONG = "This is the text of the article, and it is long enough that nobody is in doubt about it at all."


@pytest.mark.parametrize("mark", ['class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="no-comments"', 'class="search-result-page"'])
def test_layout_classes_keep_the_article(mark):
    inner = f'<p>{LONG}</p><div class="related"><article><p>{LONG[:80]}</p></article></div><div class="comments"><p>{LONG * 9}</p></div>'
    assert main_text.main_text(f"<body><div {mark}><article>{inner}</article></div></body>") == LONG
    assert main_text.main_text(f"<body><main><h1>Page</h1><section {mark}><article>{inner}</article></section></main></body>").endswith(LONG)
    text = "It is the text of the page and it has all that one needs to see that this is a text. " * 3
    assert main_text.main_text(f"<body><div {mark}><p>{text}</p></div></body>") == text.strip()
    assert main_text.main_text(f'<body><article><p>{LONG}</p></article><div class="sidebar"><p>{text * 9}</p></div></body>') == LONG


@pytest.mark.parametrize(
    "head",
    ["<head><title>T</title>", "<head><meta charset=x><script>'</p>'</script>", "<head><title>T</title></head>", "<head>", "<head><title>T</title><p>x</p></head>"],
)
@pytest.mark.parametrize("body", ["<body>", "", "<body class='no-sidebar'>"])
def test_head_without_an_end(head, body):
    assert main_text.main_text(f"<html>{head}{body}<article><p>{LONG}</p></article></html>") == LONG
    assert main_text.main_text(f"<html>{head}{body}{LONG}</html>") == LONG


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p class='x", "</p></div>", "<!--", "<script>", "&#0;&bad;", "<a<b<c>>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(main_text.main_text(page), str)


def test_page_without_article():
    good = "This is the text of the page and it has all of the words that one needs to see that it is a text. " * 3
    page = f"<body><p>Hi</p><p>{good}</p><p>Then the end.</p><ul><li><a href=x>menu entry</a></li></ul><p>x y z</p></body>"
    assert main_text.main_text(page).split("\n\n")[:3] == ["Hi", good.strip(), "Then the end."]
    assert "menu" not in main_text.main_text(page)


@pytest.mark.parametrize("piece", ["<div>x", "<div class=ad>x", "<span>x", "<p><a href=x>x", "<article class=ad>text ", "<div class=ad><article>text "])
def test_unclosed_tags_cost_the_same_each(piece):
    """Time in proportion to the tags; without that, the larger page takes a hundred times as long and more."""
    took = []
    for n in (3_000, 30_000):
        start = time.thread_time()
        main_text.main_text(piece * n)
        took.append(time.thread_time() - start)
    assert took[1] < 30 * took[0] + 1


def test_captions_and_fieldsets_of_an_article_stay():
    page = "<article><p>One text.</p><figure><img src=x><figcaption>What it shows.</figcaption></figure><fieldset>Two.</fieldset></article>"
    assert main_text.main_text(page) == "One text.\n\nWhat it shows.\n\nTwo."
    assert main_text.main_text("<article><p>One text.</p><form><fieldset>Name</fieldset></form><div class=search>Found.</div></article>") == "One text.\n\nFound."


def test_pages(spark):
    pages = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t"), (3, "w", "<p>" + "word " * 50000, "t")]
    got = main_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, None)} == {""}
    assert main_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharded_rows_keep_the_documents(spark, monkeypatch):
    """Every row once with its columns; equal rows, and rows of one id, take the places dealt to them."""
    rows = corpus.texts(9) + [(77, "again")] * 300 + [(None, "nobody")] * 40
    docs = corpus.frame(spark, rows)
    got = ring.sharded_rows(docs, 7)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert Counter((r.doc_id, r.text, r.source, r.lang) for r in found) == Counter((r.doc_id, r.text, r.source, r.lang) for r in docs.collect())
    places = sorted((r.shard, r.slot) for r in found)
    counts = Counter(s for s, _ in places)
    assert places == [(s, i) for s in sorted(counts) for i in range(counts[s])]
    assert ring.sharded_rows(docs.limit(0), 7).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = corpus.texts(12)
    docs = corpus.frame(spark, rows).withColumn("lang", F.lit("en"))
    item = next(t for _, t in rows if t and len(t.split()) > 100)
    spark.createDataFrame([(1, " ".join(item.split()[20:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, before, str(tmp_path))
        if k < len(names) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        have, left = [(r.doc_id, r.text) for r in before.collect()], None
        if k < len(names) - 1:
            left = Counter((r.doc_id, r.text) for r in after.collect())
        if name == "language ID":
            assert left == Counter(x for x in have if any(c.isalpha() for c in x[1] or ""))
        if name == "n-gram Jaccard join":
            roots = corpus.components(have)
            ids = {i for i, _, root in roots if i is not None and i == root}
            assert {i for i, _ in left if i is not None} == ids and max(left.values()) == 1
        if name == "benchmark decontamination":
            hit = corpus.contamination(have, [(1, " ".join(item.split()[20:50]))], 10)
            bad = {(i, n) for i, n, *_, flag in hit if flag}
            assert sum(left.values()) == len(have) - sum(v for (i, n, *_, f), v in hit.items() if f) and bad
        if name == "sharding":
            assert after.count() == len(have)
        before = after
    assert corpus_pipeline.ORACLE_SQL is None
