import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from holdfast.operators import explain, forest, kernel, training
from holdfast.plans import scoring
from holdfast.sources import models
from workload import q_model


def random_nodes(rng, n_trees, depth, n_features):
    rows = []
    for tree in range(n_trees):
        counter = itertools.count()

        def grow(level, cover, tree=tree, counter=counter):
            me = next(counter)
            if level == depth or cover < 4 or rng.random() < 0.15:
                rows.append((tree, me, None, None, None, None, rng.random(), float(cover)))
                return me
            left_cover = rng.randrange(1, cover)
            slot = len(rows)
            rows.append(None)
            left = grow(level + 1, left_cover)
            right = grow(level + 1, cover - left_cover)
            rows[slot] = (tree, me, rng.randrange(n_features), rng.random(), left, right, None, float(cover))
            return me

        grow(0, 200)
    return rows


def expected_value(tree, node, x, known):
    _, _, feature, threshold, left, right, value, cover = tree[node]
    if feature is None:
        return value
    if feature in known:
        return expected_value(tree, left if x[feature] <= threshold else right, x, known)
    return sum(expected_value(tree, c, x, known) * tree[c][7] for c in (left, right)) / cover


def brute_force(rows, x):
    trees = {}
    for r in rows:
        trees.setdefault(r[0], {})[r[1]] = r
    n, phi = len(x), [0.0] * len(x)

    def worth(s):
        return sum(expected_value(t, 0, x, s) for t in trees.values()) / len(trees)

    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for k in range(n):
            weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            for s in itertools.combinations(rest, k):
                phi[j] += weight * (worth({*s, j}) - worth(set(s)))
    return phi, worth(set()), worth(set(range(n)))


def frame(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x array<double>")


def test_contributions_against_enumeration(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = random_nodes(rng, 3, 5, 5)
        xs = [[rng.random() for _ in range(5)] for _ in range(6)]
        f = forest.build_forest(forest.nodes_from_rows(spark, rows), list("abcde"))
        got = forest.shap_values(forest.score_rows(frame(spark, xs), rows), f).orderBy("id").collect()
        for x, r in zip(xs, got):
            phi, base, full = brute_force(rows, x)
            assert np.allclose(r["phi"], phi, atol=1e-10)
            assert abs(f.base - base) < 1e-10 and abs(r["churn_risk"] - full) < 1e-10
            assert abs(f.base + sum(r["phi"]) - r["churn_risk"]) < 1e-9


def test_shipped_forest_agrees_with_the_expression(spark):
    rng = random.Random(5)
    rows = random_nodes(rng, 4, 4, 4)
    xs = [[rng.random() for _ in range(4)] for _ in range(20)]
    f = forest.build_forest(forest.nodes_from_rows(spark, rows), list("abcd"))
    assert f.shipped and forest.tasks_for(10**9, f) > 1 == forest.tasks_for(1, f)
    a = forest.shap_values(forest.score_rows(frame(spark, xs), rows), f, tasks=3).orderBy("id").collect()
    b = forest.with_score(forest.shap_values(frame(spark, xs), f), f).orderBy("id").collect()
    c = forest.score(frame(spark, xs), f).orderBy("id").collect()
    for p, q, r in zip(a, b, c):
        assert abs(p["churn_risk"] - q["churn_risk"]) < 1e-12 and np.allclose(p["phi"], q["phi"], atol=1e-12)
        assert abs(p["churn_risk"] - r["churn_risk"]) < 1e-12


def test_single_leaf_forest(spark):
    rows = [(0, 0, None, None, None, None, 0.25, 10.0)]
    f = forest.build_forest(forest.nodes_from_rows(spark, rows), ["a", "b"])
    r = forest.shap_values(forest.score_rows(frame(spark, [[1.0, 2.0]]), rows), f).first()
    assert r["churn_risk"] == 0.25 and r["phi"] == [0.0, 0.0] and f.base == 0.25


def training_rows(spark):
    return spark.range(400).select(
        F.col("id").alias("customer_id"),
        (F.col("id") % 7).cast("double").alias("a"),
        F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, "x").otherwise("y").alias("plan"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.lit("2025-01-01").alias("fecha_alta"),
        ((F.col("id") % 7 > 3) | (F.col("id") % 3 == 0)).cast("int").alias("abandono"),
    )


def test_roles(spark):
    roles = training.column_roles(training_rows(spark))
    assert roles == {
        "customer_id": "dropped", "a": "numeric", "plan": "categorical", "flag": "categorical",
        "fecha_alta": "dropped", "abandono": "target",
    }


def test_trained_forest_round_trip_and_explanations(spark, tmp_path):
    rows = training_rows(spark)
    model, contract = training.train(rows, trees=8, max_depth=5)
    assert contract["categories"] == {"plan": ["None", "x", "y"], "flag": ["false", "true"]}
    path = models.save_bundle(spark, model, contract, str(tmp_path / "m"))
    loaded, same = models.load_bundle(spark, path)
    assert same == contract
    f = scoring.forest_of_bundle(spark, path)
    data = training.prepare(rows, contract["numeric_cols"], contract["categorical_cols"])
    unseen = data.limit(1).withColumn("plan", F.lit("new"))
    scored = training.probability(data.unionByName(unseen), loaded, keep_vector=True)
    explained = forest.with_score(forest.shap_values(scored, f), f, out="own").collect()
    for r in explained:
        assert abs(r["own"] - r["churn_risk"]) < 1e-9
        assert abs(f.base + sum(r["phi"]) - r["churn_risk"]) < 1e-9
    assert [r for r in explained if r["plan"] == "new"][0]["x"][1:4] == [0.0, 0.0, 0.0]
    assert training.auc(scored.filter("plan <> 'new'").withColumn("_label", F.col("abandono").cast("double"))) > 0.9


def test_folds_are_balanced_for_one_repeated_key(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("abandono"))
    for bucket_rows in (200_000, 50):
        folds = training.stratified_folds(rows, bucket_rows=bucket_rows).groupBy("abandono", "_fold").count().collect()
        for label in (0, 1):
            sizes = [r["count"] for r in folds if r["abandono"] == label]
            assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_local_reasons_fold_and_fallback(spark):
    origins = ["a", "b", "plan", "plan"]
    rows = spark.createDataFrame(
        [(1, 3.0, 4.5, "x", [0.2, -0.3, 0.3, -0.25]), (2, 1.0, 0.0, "y", [1e-11, 2e-11, 0.0, -3e-11]), (3, 1.0, 2.0, "z", [0.0, 0.1, 0.0, 0.0])],
        "id int, a double, b double, plan string, phi array<double>",
    )
    got = {r["id"]: r["reasons"] for r in explain.local_reasons(rows, origins, ["plan", "a", "b"], top_k=2).collect()}
    assert [(e["feature"], round(e["impact"], 6), e["effect"], e["value"]) for e in got[1]] == [
        ("plan", 0.05, "sube_riesgo", "x"),
        ("b", -0.3, "baja_riesgo", "4.5"),
    ]
    # Nothing above the noise: names of the contract by position.
    assert [(e["feature"], e["impact"]) for e in got[2]] == [("a", 2e-11), ("plan", 1e-11)]
    assert [e["feature"] for e in got[3]] == ["b"]


def test_global_importance_means(spark):
    rows = spark.createDataFrame([([1.0, 0.5, -0.5],), ([-1.0, 0.0, 0.5],)], "phi array<double>")
    got = explain.global_importance(rows, explain.encoded_origins(["a"], {"plan": ["x", "y"]})).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("a", 2.0, 1.0, 0.0, 1), ("plan", 1.5, 0.375, 0.125, 2)]


def test_neighbouring_paths_share_tables():
    """The same contributions by tables of groups, by a table per path and row by row, over repeated features and ranks of every kind."""
    rng = np.random.default_rng(5)
    parts = []
    for tree in range(4):
        features, low, high, share = [], [], [], []
        for leaf in range(60):
            d = int(rng.integers(1, 7)) if leaf else 13
            names = sorted(rng.choice(15, d, replace=False).tolist())
            a = rng.integers(0, 5, d).tolist()
            features.append(names)
            low.append(a)
            high.append([kernel.TOP if rng.random() < 0.4 else x + int(rng.integers(0, 3)) for x in a])
            share.append(rng.random(d).tolist())
        parts.append(kernel.group_paths(features, low, high, share, rng.random(60).tolist()))
    blocks = kernel.merge_blocks(parts)
    groups = np.concatenate([b["group"] for b in blocks])
    assert len(np.unique(groups)) < 120 and sum(len(b["value"]) for b in blocks) == 240
    ranks = rng.integers(0, 8, (15, kernel.GROUPED_ROWS + 9)).astype(np.uint16)
    got = kernel.contributions(ranks, blocks)
    one = np.zeros(ranks.shape)
    for b in blocks:
        kernel._add_by_row(ranks, b, one)
    assert np.allclose(got, one, atol=1e-12) and np.allclose(kernel.contributions(ranks[:, :50], blocks), one[:, :50], atol=1e-12)


def test_a_roundtrip_scores_in_many_tasks(spark, tmp_path, monkeypatch):
    """Rows that come in one partition are dealt evenly before two models score them."""
    model, contract = training.train(training_rows(spark), trees=3, max_depth=3)
    path = models.save_bundle(spark, model, contract, str(tmp_path / "bundle"))
    score, parts = training.probability, []

    def watched(df, model, out="churn_risk", keep_vector=False):
        parts.append([r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()])
        return score(df, model, out, keep_vector)

    monkeypatch.setattr(q_model, "bundle", lambda spark, sf_dir: path)
    monkeypatch.setattr(q_model, "feature_rows", lambda spark, sf_dir: training_rows(spark).coalesce(1))
    monkeypatch.setattr(training, "probability", watched)
    assert [tuple(r) for r in q_model.model_roundtrip(spark, "").collect()] == [(400, 0, 1)]
    assert len(parts) == 2 and all(len(p) >= 16 and sum(p) == 400 and max(p) <= 2 * min(p) for p in parts)
