"""Repeats, near copies and benchmark passages against brute force."""

import random
import re
from collections import Counter

import corpus
import pytest
from pyspark.sql import functions as F

from holdfast.llm import doubling, group_join, suffix_dedup, winnowing
from holdfast.llm.components import components, with_values


def collected(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return corpus.texts()


@pytest.mark.parametrize("window", [50, 12])
def test_word_repeats(spark, rows, window):
    assert collected(doubling.remove_repeats(corpus.frame(spark, rows), window)) == corpus.word_repeats(rows, window)


def test_levels_are_halves():
    assert doubling.levels(50) == [13, 25, 50]
    assert doubling.levels(12) == [12]
    assert doubling.levels(100) == [13, 25, 50, 100]


@pytest.mark.parametrize("part_bytes", [suffix_dedup.PART_BYTES, 3000])
def test_byte_repeats(spark, rows, part_bytes):
    found = suffix_dedup.remove_repeats(corpus.frame(spark, rows, 5), part_bytes=part_bytes)
    assert collected(found) == corpus.byte_repeats(rows, 50)


def test_byte_repeats_merge_parts(spark):
    """Many documents around one passage, so that shards are cut and their windows merged."""
    import random

    rng = random.Random(5)
    core = "".join(rng.choice("abcdefgh") for _ in range(90))
    noise = lambda: "".join(rng.choice("ijklmnop") for _ in range(60))
    rows = [(rng.randrange(10**6), noise() + core[: rng.randrange(55, 90)] + noise()) for _ in range(120)]
    found = suffix_dedup.remove_repeats(corpus.frame(spark, rows, 12), part_bytes=500)
    assert collected(found) == corpus.byte_repeats(rows, 50)


def test_suffix_array_and_prefixes():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(100):
        data = np.array([rng.choice([0, 0, 1, 255]) for _ in range(rng.randrange(0, 60))], np.uint8)
        text = data.tobytes()
        order, rank = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        prefix = suffix_dedup.common_prefixes(data, order, rank, 6, lanes=rng.choice([1, 4, 99]))
        for i in range(1, len(text)):
            a, b = text[order[i - 1] :], text[order[i] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert prefix[i] == min(n, 6)


def test_near_copies(spark, rows):
    found = group_join.jaccard_components(corpus.frame(spark, rows)).drop("mark")
    assert collected(found) == corpus.components(rows)


def test_near_copies_in_chains_and_large_groups(spark, monkeypatch):
    """Each edit stays close to the last one only, and groups fall into several blocks."""
    import random

    monkeypatch.setattr(group_join, "BLOCK", 4)
    rng = random.Random(2)
    rows, w = [], [f"v{rng.randrange(900)}" for _ in range(80)]
    for i in range(60):
        w = list(w)
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((rng.randrange(10**6), " ".join(w)))
    base = [f"b{rng.randrange(900)}" for _ in range(60)]
    for i in range(60):
        v = list(base)
        v[rng.randrange(60)] = f"other{i}"
        rows.append((rng.randrange(10**6), " ".join(v)))
    found = group_join.jaccard_components(corpus.frame(spark, rows)).drop("mark")
    assert collected(found) == corpus.components(rows)


def test_components_write_once_a_round(spark, monkeypatch):
    """A chain of 64 nodes takes few rounds, and a round is one written table."""
    from holdfast.llm import components as module

    write, names = module.stored, []
    monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or write(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(63)], "a long, b long")
    assert {r.root for r in components(links, "a", "b").collect()} == {0}
    assert names.count("links") == 1
    assert names.count("labels") <= 8


def test_values_of_large_keys_join_each_row_once(spark):
    """Large keys, small keys, keys without a value and null: every row comes back once, by one outer join."""
    keys = [1] * 50 + [2, 3, 3, None, None, 9]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    table = spark.createDataFrame([(1, 3000, 10), (2, 1, 20), (3, 2, 30)], "k int, n long, v int")
    found = with_values(rows, table, "k", "n", 3003, "v")
    assert sorted((r.id, r.v or 0) for r in found.collect()) == [(i, {1: 10, 2: 20, 3: 30}.get(k, 0)) for i, k in enumerate(keys)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


def test_joins_of_growing_tables_do_not_go_through_the_driver(spark, monkeypatch):
    """Tables whose files are small are joined by a shuffle: labels of many links, values of keys, members of open blocks."""
    from holdfast.llm import components as module

    write, verify, plans, pairs = module.stored, group_join._verified, [], []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    links = write(spark.range(20_000).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b")), "given")
    monkeypatch.setattr(module, "stored", lambda df, name: plans.append(plan(df)) or write(df, name))
    assert components(links, "a", "b").where("root <> node - node % 2").count() == 0
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)

    table = write(spark.range(5000).select("id", F.lit(1).alias("n"), F.col("id").alias("v")), "values")
    found = plan(with_values(links.select(F.col("a").alias("id")), table, "id", "n", 5000, "v"))
    assert re.search(r"SortMergeJoin \[id#\d+L\], \[id#\d+L\], LeftOuter", found)

    monkeypatch.setattr(group_join, "_verified", lambda df, *rest: pairs.append(plan(df)) or verify(df, *rest))
    group_join.jaccard_components(corpus.frame(spark, corpus.texts(3)))
    opened = [p for p in pairs if "sequence(" in p]
    assert opened and all("SortMergeJoin [block" in p and "BroadcastHashJoin [block" not in p for p in opened)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 9), (None, 3), (7, 7)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5), 1), 9: 9, 10: 9, 7: 7, **dict.fromkeys(range(20, 61), 20)}


def test_benchmark(spark, rows):
    long = [t for _, t in rows if t and len(t) > 900][0]
    items = [(1, " ".join(long.split(" ")[3:30])), (2, "W1! w2"), (3, None), (4, ""), (None, "one"), (5, "a b, c d e"), (5, "A B")]
    items += [(10, " ".join(long.split(" ")[20:31])), (11, "?!")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, span string")
    assert collected(winnowing.contamination(corpus.frame(spark, rows), bench)) == corpus.contamination(rows, items, 10)
    none = winnowing.contamination(corpus.frame(spark, rows), bench.limit(0))
    assert collected(none) == corpus.contamination(rows, [], 10)


def test_benchmark_items_of_every_length(spark, rows):
    long = [t for _, t in rows if t and len(t) > 900][0].split(" ")
    items = [(n, " ".join(long[5 * n : 6 * n])) for n in range(1, 13)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(winnowing.contamination(corpus.frame(spark, rows), bench)) == corpus.contamination(rows, items, 10)


def test_runs_by_doubling(spark):
    """Least values and hashes of runs of any length, and of arrays that are shorter than the run."""
    arrays = [[5, 3, 8, 1, 9, 2, 7, 7, 0, 4], [3], [], [2, 1]]
    table = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id int, a array<int>")
    for n in range(1, 9):
        out = winnowing._with_runs(table, "a", "m", n, lambda a, b: F.least(a, b), joint=True)
        out = winnowing._with_runs(out, "a", "s", n, lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string")) if n > 1 else a, joint=False)
        for r in out.collect():
            a = arrays[r.id]
            assert r.m == [min(a[i : i + n]) for i in range(len(a) - n + 1)]
            if n > 1:
                assert r.s == ["-".join(map(str, a[i : i + n])) for i in range(len(a) - n + 1)]


@pytest.mark.parametrize("named_by", [1, 16])
def test_join_where_leaders_find_little(spark, monkeypatch, named_by):
    """Chains of texts of which only neighbours link, and many texts with one passage that do not link."""
    monkeypatch.setattr(group_join, "NAMED_BY", named_by)
    monkeypatch.setattr(group_join, "ROUNDS", 1)
    monkeypatch.setattr(group_join, "BLOCK", 3)
    rng = random.Random(4)
    word = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    passage, made, i = word(30), [], 0
    for _ in range(25):
        made.append((i := i + 1, " ".join(passage + word(rng.choice([1, 2, 6, 7])))))
    for _ in range(6):
        text = word(60)
        for _ in range(6):
            made.append((i := i + 1, " ".join(text)))
            at = rng.randrange(50)
            text = text[:at] + word(1) + text[at + 1 :]
    rng.shuffle(made)
    found = group_join.jaccard_components(corpus.frame(spark, made)).drop("mark")
    assert collected(found) == corpus.components(made)


def test_large_groups_of_near_copies_compare_few_pairs(spark, monkeypatch):
    """Copies with one to nine edits, on both sides of the limit: what is left to compare is far below all pairs."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = [(10**6, " ".join(base))]
    for i in range(300):
        v = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 10)):
            v[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    compared, asks = group_join._compared, []

    def counted(asked, placed, sets, percent):
        members = placed.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
        asks.append(asked.join(members, "block").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])
        return compared(asked, placed, sets, percent)

    monkeypatch.setattr(group_join, "_compared", counted)
    found = group_join.jaccard_components(corpus.frame(spark, rows)).drop("mark")
    assert collected(found) == corpus.components(rows)
    assert asks[0] < 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_around_the_limit(spark, monkeypatch, seed):
    """Texts with words left out, put in and replaced by few others, so that sizes differ and edits are shared."""
    monkeypatch.setattr(group_join, "BLOCK", 3)
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        base = [f"b{k}-{i}" for i in range(rng.randrange(40, 90))]
        for i in range(50):
            v = list(base)
            for _ in range(rng.randrange(0, 6)):
                at = rng.choice([3, 11, 20, 31, rng.randrange(len(v))])
                v[at : at + rng.randrange(2)] = [f"new{rng.randrange(3)}"] * rng.randrange(3)
            rows.append((1000 * k + i, " ".join(v)))
    rng.shuffle(rows)
    found = group_join.jaccard_components(corpus.frame(spark, rows)).drop("mark")
    assert collected(found) == corpus.components(rows)


def test_native_plan(spark, rows):
    """Winnowing runs no Python."""
    found = winnowing.contamination(corpus.frame(spark, rows), spark.createDataFrame([(1, "one")], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("run", [doubling.remove_repeats, suffix_dedup.remove_repeats, group_join.jaccard_components])
def test_empty_table(spark, run):
    assert run(corpus.frame(spark, []).limit(0)).count() == 0


def test_empty_documents_for_benchmark(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert winnowing.contamination(corpus.frame(spark, []).limit(0), bench).count() == 0
