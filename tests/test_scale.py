"""Parts that only matter at scale, at sizes at which they can be compared with plain ones."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import ASOF, ATTENDANCE, PAYMENTS, STUDENTS, day
from test_forest import brute_force, frame, random_nodes, training_rows

from holdfast.operators import features as ft
from holdfast.operators import forest, membership, search, training, typing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Forests as tables


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 7)
    monkeypatch.setattr(forest, "GROUP_BYTES", 2000)
    monkeypatch.setattr(forest, "PART_PATHS", 5)


def test_grid_agrees_with_enumeration_and_shipped_forest(spark, small_cells):
    for seed in range(2):
        rng = random.Random(seed)
        rows = random_nodes(rng, 5, 5, 5)
        xs = [[rng.random() for _ in range(5)] for _ in range(12)]
        nodes = forest.nodes_from_rows(spark, rows)
        shipped, table = (forest.build_forest(nodes, list("abcde"), b) for b in (1 << 20, 0))
        assert shipped.shipped and not table.shipped and not table.trees and not table.blocks
        assert (shipped.n_paths, shipped.n_trees) == (table.n_paths, table.n_trees) == (sum(r[2] is None for r in rows), 5)
        rows_of = frame(spark, [*xs, *xs[:3]])
        a = forest.score(forest.shap_values(rows_of, shipped, tasks=2), shipped).orderBy("id").collect()
        b = forest.score(forest.shap_values(rows_of, table), table).orderBy("id").collect()
        assert len(a) == len(b) == 15
        for p, q in zip(a, b):
            phi, base, full = brute_force(rows, p["x"])
            assert np.allclose(p["phi"], phi, atol=1e-10) and np.allclose(q["phi"], phi, atol=1e-10)
            assert abs(p["churn_risk"] - full) < 1e-10 and abs(q["churn_risk"] - full) < 1e-10
            assert abs(shipped.base - base) < 1e-10 and abs(table.base - base) < 1e-10


def test_grid_plan_holds_no_path_and_explains_equal_ranks_once(spark, small_cells):
    rng = random.Random(3)
    table = forest.build_forest(forest.nodes_from_rows(spark, random_nodes(rng, 3, 4, 3)), list("abc"), 0)
    x = [rng.random() for _ in range(3)]
    out = forest.shap_values(frame(spark, [x] * 40 + [[v + 1e-12 for v in x]] * 2), table)
    plan = plan_of(out)
    assert "MapInArrow" in plan and "FileScan" in plan and "ArrowEvalPython" not in plan
    # One vector, although there are 42 rows.
    ranks = frame(spark, [x] * 40).select(forest._rank_column(table, "x").alias("r")).distinct()
    assert ranks.count() == 1 and out.select("phi").distinct().count() == 1


def test_missing_numbers_go_right(spark):
    rows = [(0, 0, 0, 0.5, 1, 2, None, 10.0), (0, 1, None, None, None, None, 0.1, 4.0), (0, 2, None, None, None, None, 0.9, 6.0)]
    nodes = forest.nodes_from_rows(spark, rows)
    data = frame(spark, [[float("nan")], [0.5], [0.6]])
    for bound in (0, 1 << 20):
        got = forest.score(data, forest.build_forest(nodes, ["a"], bound)).orderBy("id").collect()
        assert [r["churn_risk"] for r in got] == [0.9, 0.1, 0.9]


def test_many_features_of_a_path(spark):
    """Paths beyond the pattern tables, for few and for many rows."""
    rng, width = random.Random(9), 12
    rows = [(0, i, i, 0.5, i + 1, 100 + i, None, float(200 - 10 * i)) for i in range(width)]
    rows += [(0, 100 + i, None, None, None, None, rng.random(), 10.0) for i in range(width)]
    rows.append((0, width, None, None, None, None, 0.7, float(200 - 10 * width)))
    f = forest.build_forest(forest.nodes_from_rows(spark, rows), [str(i) for i in range(width)])
    xs = [[rng.random() for _ in range(width)] for _ in range(5000)]
    many = forest.with_score(forest.score(forest.shap_values(frame(spark, xs).coalesce(1), f), f), f, out="own").collect()
    few = forest.shap_values(frame(spark, xs[:3]).coalesce(1), f).orderBy("id").collect()
    assert all(abs(r["own"] - r["churn_risk"]) < 1e-9 for r in many)
    for r in few:
        assert np.allclose(r["phi"], next(m["phi"] for m in many if m["id"] == r["id"]), atol=1e-12)


# Cross-validation and AUC


def test_every_row_is_scored_once_by_a_forest_that_has_not_seen_it(spark):
    rows = training_rows(spark).withColumn("noise", F.rand(5))
    # Labels without any pattern: a forest that had seen a row would know its label.
    coin = rows.withColumn("abandono", F.pmod(F.xxhash64("customer_id"), F.lit(2)).cast("int"))
    scored = training.out_of_fold_scores(coin, trees=20, max_depth=20, keep=["customer_id"])
    assert scored.columns == ["customer_id", "_fold", "_label", "churn_risk"]
    assert scored.count() == scored.select("customer_id").distinct().count() == 400
    assert training.auc(scored) < 0.65
    seen, _ = training.train(coin, trees=20, max_depth=20)
    assert training.auc(training.probability(training.prepare(coin, ["a", "noise"], ["plan", "flag"]).withColumn("_label", F.col("abandono").cast("double")), seen)) > 0.9


def test_cross_validation_finds_a_pattern(spark):
    found = training.cross_validate(training_rows(spark), folds=3, trees=10, max_depth=5, train_rows=150).orderBy("fold").collect()
    assert [r["fold"] for r in found] == [0, 1, 2] and sum(r["rows"] for r in found) == 400
    assert all(0.9 < r["auc"] <= 1 for r in found)


def test_cross_validation_needs_both_classes(spark):
    one = training_rows(spark).withColumn("abandono", F.lit(1))
    with pytest.raises(ValueError, match="two folds"):
        training.cross_validate(one, folds=3, trees=2, max_depth=2)


def test_fold_weights_leave_the_fold_out():
    assert training._fold_weights({(0, 0.0): 5, (0, 1.0): 5, (1, 0.0): 30, (1, 1.0): 10}, 0) == {0.0: 40 / 60, 1.0: 2.0}


def test_auc_by_ranges(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5, 0.25]), rng.choice([0.0, 1.0])) for g in (0, 1, 2, None) for _ in range(300)] + [(3, 0.1, 1.0)]
    table = spark.createDataFrame(rows, "fold int, churn_risk double, _label double").repartition(5)
    got = {r["fold"]: r for r in training.auc_by(table, "fold").collect()}
    for g in (0, 1, 2, None, 3):
        mine = [(s, y) for f, s, y in rows if f == g]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        assert (got[g]["rows"], got[g]["positives"]) == (len(mine), len(pos))
        if neg:
            area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
            assert abs(got[g]["auc"] - area) < 1e-9
        else:
            assert got[g]["auc"] is None
    assert "Exchange rangepartitioning" in plan_of(training.auc_by(table, "fold"))


# Chosen ids, hot keys, daily partials


def history(rng, n, ids):
    att = [(rng.choice(ids), day(rng.randrange(-4, 200), rng.choice([0, 0, 9])), rng.choice([0, 1, None])) for _ in range(n)]
    pay = [(rng.choice([i, None]), rng.choice(ids), day(rng.randrange(-4, 200), rng.choice([0, 0, 23])), rng.randrange(90), rng.choice([None, "PAID", "no"])) for i in range(n)]
    return att, pay


def test_bloom_filter_keeps_all_keys_and_drops_most_others(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") * 7).alias("k"))
    rows = spark.range(30_000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).cast("int").alias("student_id"))
    kept = membership.possible(rows, "student_id", keys, "k", 1000)
    wanted = rows.join(keys.select(F.col("k").cast("int").alias("student_id")), "student_id", "left_semi")
    assert wanted.subtract(kept).count() == 0 and wanted.count() > 900
    assert kept.count() < wanted.count() + 1500
    assert membership.possible(rows, "student_id", keys.limit(0), "k", 0).count() == 0


def test_chosen_ids_thin_out_the_scans(spark, tmp_path):
    rng = random.Random(4)
    att, pay = history(rng, 2000, range(300))
    frames = {"students": ([(i, "2024-01-01", "A", "1") for i in range(300)], STUDENTS), "attendance": (att, ATTENDANCE), "payments": (pay, PAYMENTS)}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    tables = [spark.read.parquet(str(tmp_path / n)) for n in frames]
    ids = spark.createDataFrame([(5,), (5,), (77,), (None,), (1000,)], "student_id long")
    got = ft.features_of(ids, *tables, ASOF)
    full = ft.student_features(*tables, ASOF).where("student_id IN (5, 77)")
    assert sorted(got.collect()) == sorted(full.collect())
    lines = [line.lstrip(" :+-") for line in plan_of(got).splitlines()]
    filters = [i for i, line in enumerate(lines) if re.match(r"(\*\(\d+\) )?Filter .*getbit", line)]
    filtered = set()
    for i in filters:
        # Right below the partial sums of a history, right above its scan.
        above = next(line for line in reversed(lines[:i]) if "HashAggregate" in line)
        below = next(line for line in lines[i:] if "FileScan" in line)
        assert "partial_max" in above
        filtered |= {c for c in ("class_date", "payment_date") if f"{c}:timestamp_ntz" in below}
    assert filtered == {"class_date", "payment_date"}


def test_hot_and_missing_keys_are_spread(spark):
    rng = random.Random(6)
    ids = [7 if i % 2 else None if i % 4 == 0 else i for i in range(4000)]
    students = spark.createDataFrame([(s, f"2024-01-{i % 28 + 1:02d}", f"p{i}", str(i)) for i, s in enumerate(ids)], STUDENTS)
    att, pay = history(rng, 3000, [*range(0, 4000, 9), 7, None])
    attendance, payments = spark.createDataFrame(att, ATTENDANCE), spark.createDataFrame(pay, PAYMENTS)
    assert ft.hot_keys(students, "student_id") == ([7], True)
    assert ft.hot_keys(students.where("student_id <> 7"), "student_id") == ([], False)
    plain = ft.student_features(students, attendance, payments, ASOF, hot=((), False))
    spread = ft.student_features(students, attendance, payments, ASOF)
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))
    n = 40
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = []
        for hot in (((), False), None):
            rows = ft.student_features(students, attendance, payments, ASOF, hot=hot)
            parts = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("total_classes_90d"), F.sum("n_payments_90d"))
            sizes.append(max(r["n"] for r in parts.collect()))
    finally:
        for key, value in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.autoBroadcastJoinThreshold", "10485760")):
            spark.conf.set(key, value)
    # Some of the 40 pieces share a partition.
    assert sizes[0] >= 2000 and sizes[1] < sizes[0] / 5


def test_daily_partials_answer_every_day(spark, tmp_path):
    rng = random.Random(12)
    att, pay = history(rng, 1500, [*range(25), None])
    students = spark.createDataFrame([(i, "2024-01-01", "A", "1") for i in [*range(30), None, 3]], STUDENTS)
    attendance, payments = spark.createDataFrame(att, ATTENDANCE), spark.createDataFrame(pay, PAYMENTS)
    for part in range(3):
        ft.extend_daily(ft.daily_attendance(attendance.where(F.pmod(F.hash("class_date", "student_id"), F.lit(3)) == part)), str(tmp_path / "a"))
        ft.extend_daily(ft.daily_payments(payments.where(F.pmod(F.hash("payment_id"), F.lit(3)) == part)), str(tmp_path / "p"))
    ft.extend_daily(ft.daily_payments(payments.where("hash(payment_id) IS NULL")), str(tmp_path / "p"))
    for asof in (ASOF, "2025-02-11", "2024-12-01", "2020-01-01"):
        cutoff = dt.date.fromisoformat(asof) - dt.timedelta(days=1)
        kept = [ft.read_daily(spark, str(tmp_path / n), cutoff) for n in "ap"]
        got = ft.features_from_daily(students, *kept, asof)
        full = ft.student_features(students, attendance, payments, asof)
        assert got.columns == full.columns and sorted(map(repr, got.collect())) == sorted(map(repr, full.collect()))


# Row ids and search


def test_scan_row_ids_follow_files_and_lines(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text("a,b\n" + "".join(f"{f},{i}\n" for i in range(200 + f)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.option("header", True).csv(str(tmp_path))
        rows = typing.scan_row_ids(scan.where("b <> '5'"), start=10).orderBy("_row_id").collect()
        assert scan.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    assert [r["_row_id"] for r in rows] == list(range(11, 11 + len(rows))) and len(rows) == 600
    assert [(int(r["a"]), int(r["b"])) for r in rows] == [(f, i) for f in range(3) for i in range(200 + f) if i != 5]


def test_scan_row_ids_write_nothing_before(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    plan = plan_of(typing.scan_row_ids(spark.read.parquet(str(tmp_path / "t"))))
    assert "hashpartitioning" not in plan and plan.count("FileScan") == 1 and plan.count("ExistingRDD") == plan.count("ExistingRDD[_key")
    assert typing.scan_row_ids(spark.read.parquet(str(tmp_path / "t")).limit(0).where("false")).count() == 0


def test_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(1)
    names = ["".join(rng.choice("abÄß #%_.") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    rows = [(i if i % 40 else None, n, None if i % 7 == 0 else n[::-1].upper() + "@x.org") for i, n in enumerate(names)]
    rows += [(1, "twice", None), (1, "other", "a@x.org")]
    students = spark.createDataFrame(rows, "student_id long, name string, email string").repartition(3)
    index = search.write_index(students, str(tmp_path / "i"), files=5)
    for text in ("ab", "", "aba", "ABA", "x.org", "org@", "%_.", "ä", "äb#", "zzz", "twice", "bab", "#%_"):
        found = search.with_result_count(search.search(spark, index, students, text))
        want = sorted(repr((i, n)) for i, n, e in rows if text.lower() in (n or "").lower() or text.lower() in (e or "").lower())
        got = found.collect()
        assert sorted(repr((r["student_id"], r["name"])) for r in got) == want
        assert {r["results"] for r in got} <= {len(want)}


def test_search_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS_PER_TASK", 200)
    rows = [(i if i % 9 else None, f"student {i % 70:04d}", None) for i in range(280)] * 2
    students = spark.createDataFrame(rows, "student_id long, name string, email string").coalesce(1)
    index = search.write_index(students, str(tmp_path / "i"))
    postings = spark.read.parquet(f"{index}/postings")
    # 560 rows with 10 trigrams each.
    assert len(postings.inputFiles()) > 20 and postings.count() == postings.distinct().count()
    found = search.search(spark, index, students, "Ent 001")
    assert found.count() == sum("ent 001" in n for _, n, _ in rows) == 80
