"""Encoding, training, evaluation and scoring."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.operators import explain, features, forest, reports, training
from holdfast.plans import scoring
from holdfast.session import materialize, work_path
from holdfast.sources import models
from workload.model import (
    MAX_DEPTH,
    TRAIN_ROWS,
    TREES,
    aligned_rows,
    bundle,
    feature_rows,
    loaded,
    model_columns,
    training_rows,
    training_table,
)
from workload.oracle import NUMBERS, statement
from workload.pinned import CATEGORIES, CONTRACT, NODES
from workload.tables import ASOF, core, view


def pinned_scores(spark, rows):
    """Feature rows with the score of the fixed forest."""
    x = explain.encode(scoring.aligned(rows, CONTRACT), CONTRACT["numeric_cols"], CONTRACT["categories"])
    return forest.score_rows(x, NODES)


def onehot_features(spark, sf_dir):
    rows = training.prepare(feature_rows(spark, sf_dir), NUMBERS, ["plan"])
    model = training.encoder(NUMBERS, ["plan"]).fit(rows)
    names = explain.encoded_names(NUMBERS, training.categories_of(model, ["plan"]))
    x = model.transform(rows).select("student_id", vector_to_array(training.VECTOR).alias("x"))
    wide = x.select("student_id", *[F.col("x")[i].alias(n.replace("=", "_")) for i, n in enumerate(names)])
    return wide.withColumn("months_since_last_payment", F.round("months_since_last_payment", 6))


def class_weights(spark, sf_dir):
    return training.class_weights(training_table(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def stratified_folds(spark, sf_dir):
    folds = training.stratified_folds(training_table(spark, sf_dir).select("student_id", "abandono"))
    return folds.groupBy("abandono", F.col(training.FOLD).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("student_id").alias("students")
    )


def train_model(spark, sf_dir):
    """Trains the whole forest; reports what must hold for any seed."""
    path = bundle(spark, sf_dir, anew=True)
    model, contract = loaded(spark, path)
    scored = training.probability(aligned_rows(spark, sf_dir, contract), model)
    p = F.col("churn_risk")
    labels = training_rows(spark, sf_dir).select(F.col("customer_id").alias("student_id"), F.col("abandono").alias(training.LABEL))
    area = training.auc(scored.join(labels, "student_id"))
    nodes = forest.nodes_of_model(spark, models.forest_folder(spark, path))
    covers = nodes.groupBy("tree_id").agg(
        F.sum(F.when(F.col("left").isNull(), F.col("cover"))).alias("leaves"), F.max("cover").alias("root")
    )
    uneven = covers.agg(F.count_if(F.abs(F.col("leaves") - F.col("root")) > 1e-6 * F.col("root"))).first()[0]
    return scored.agg(
        F.lit(int(area > 0.9)).cast("bigint").alias("fits_training_rows"),
        F.lit(uneven).cast("bigint").alias("trees_with_lost_cover"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.between(0.0, 1.0)).alias("in_range"),
        F.lit(model.stages[-1].getNumTrees).cast("bigint").alias("trees"),
        F.lit(model.stages[-1].numFeatures).cast("bigint").alias("encoded_columns"),
        F.lit(model.stages[-1].getMaxDepth()).cast("bigint").alias("max_depth"),
    )


def cv_auc(spark, sf_dir):
    """Of the fixed forest, by folds of a hash that any engine has."""
    scored = pinned_scores(spark, feature_rows(spark, sf_dir)).select("student_id", F.round("churn_risk", 9).alias("churn_risk"))
    labels = training_table(spark, sf_dir).select("student_id", F.col("abandono").alias(training.LABEL))
    digit = F.instr(F.lit("0123456789abcdef"), F.left(F.md5(F.col("student_id").cast("string").cast("binary")), F.lit(1)))
    fold = F.pmod(digit, F.lit(training.FOLDS)).cast("int")
    return training.auc_by(scored.join(labels, "student_id").withColumn("fold", fold), "fold")


def cv_trained(spark, sf_dir):
    """Out-of-fold scores of all rows by five forests of the library's size; AUCs are reported as lying in [0, 1]."""
    table = training_table(spark, sf_dir)
    scored = training.out_of_fold_scores(model_columns(table), keep=["customer_id"], train_rows=TRAIN_ROWS)
    scored = materialize(scored.withColumnRenamed(training.FOLD, "fold"))
    areas = training.auc_by(scored, "fold")
    once = scored.groupBy("fold").agg(
        F.count_distinct("customer_id").alias("students"), F.count_if(F.col("churn_risk").between(0.0, 1.0)).alias("in_range")
    )
    return areas.join(once, "fold").select(
        "fold", "rows", "positives", "students", "in_range", F.col("auc").between(0.0, 1.0).alias("area_in_range")
    )


def auc(spark, sf_dir):
    """Of the fixed forest against the training target."""
    scored = pinned_scores(spark, feature_rows(spark, sf_dir)).select("student_id", F.round("churn_risk", 9).alias("churn_risk"))
    labels = training_table(spark, sf_dir).select("student_id", F.col("abandono").alias(training.LABEL))
    area = training.auc(scored.join(labels, "student_id"))
    return spark.createDataFrame([(round(area, 9),)], "auc double")


def score_all_rf(spark, sf_dir):
    path = bundle(spark, sf_dir)
    ensemble, contract = scoring.forest_of_bundle(spark, path), models.load_contract(spark, path)
    scored = scoring.score_all(*core(spark, sf_dir), ensemble, contract, ASOF)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("student_id").alias("students"),
        F.count_if(F.col("churn_risk").between(0.0, 1.0)).alias("in_range"),
        F.min("asof_date").alias("asof_date"),
    )


def model_roundtrip(spark, sf_dir):
    """Rows whose score changes when the model is saved and loaded again."""
    model, contract = models.load_bundle(spark, bundle(spark, sf_dir))
    again, same = models.load_bundle(spark, models.save_bundle(spark, model, contract, work_path(spark, "copy")))
    rows = training.dealt(scoring.aligned(feature_rows(spark, sf_dir), contract))
    first = training.probability(rows, model, "before")
    both = training.probability(first, again, "after")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("before") != F.col("after")).alias("different"),
        F.lit(int(same == contract)).cast("bigint").alias("same_contract"),
    )


def score_all(spark, sf_dir):
    scored = pinned_scores(spark, feature_rows(spark, sf_dir))
    return scoring.by_risk(scored.select("student_id", F.lit(ASOF).alias("asof_date"), F.round("churn_risk", 9).alias("churn_risk")))


def top_risk(spark, sf_dir):
    scored = pinned_scores(spark, feature_rows(spark, sf_dir))
    return scoring.by_risk(scored.select("student_id", F.round("churn_risk", 9).alias("churn_risk")), limit=20)


def score_latest(spark, sf_dir):
    """Chosen students as of the last day in the data, by the trained forest."""
    path = bundle(spark, sf_dir)
    ensemble, contract = scoring.forest_of_bundle(spark, path), models.load_contract(spark, path)
    ids = view(spark, sf_dir, "payments").filter("amount > 300000").select("student_id")
    scored = scoring.score_students(ids, *core(spark, sf_dir), ensemble, contract)
    return scored.select("student_id", "asof_date", F.col("churn_risk").between(0.0, 1.0).alias("in_range"))


def score_students(spark, sf_dir):
    """Students named in a table: those with a payment above 300,000."""
    ids = view(spark, sf_dir, "payments").filter("amount > 300000").select("student_id").distinct()
    rows = features.features_of(ids, *core(spark, sf_dir), ASOF)
    return pinned_scores(spark, rows).select("student_id", F.round("churn_risk", 9).alias("churn_risk"))


def kpi_high_risk(spark, sf_dir):
    return reports.high_risk_count(pinned_scores(spark, feature_rows(spark, sf_dir)))


def revenue_at_risk(spark, sf_dir):
    return reports.revenue_at_risk(pinned_scores(spark, feature_rows(spark, sf_dir)))


QUERIES = {
    "onehot_features": onehot_features,
    "class_weights": class_weights,
    "stratified_folds": stratified_folds,
    "train_model": train_model,
    "cv_auc": cv_auc,
    "cv_trained": cv_trained,
    "auc": auc,
    "score_all_rf": score_all_rf,
    "model_roundtrip": model_roundtrip,
    "score_all": score_all,
    "top_risk": top_risk,
    "score_latest": score_latest,
    "score_students": score_students,
    "kpi_high_risk": kpi_high_risk,
    "revenue_at_risk": revenue_at_risk,
}

_HOT = ", ".join(f"CASE WHEN plan = '{c}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"plan_{c}\"" for c in CATEGORIES)
_RISK = "round(churn_risk, 9) AS churn_risk"

ORACLES = {
    "onehot_features": statement(
        "SELECT student_id, "
        + ", ".join(
            "round(months_since_last_payment, 6) AS months_since_last_payment" if c.startswith("months") else f"CAST({c} AS DOUBLE) AS {c}"
            for c in NUMBERS
        )
        + f", {_HOT} FROM features",
        "features",
    ),
    "class_weights": statement(
        """SELECT abandono AS label, count(*) AS n,
round(CAST((SELECT count(*) FROM training) AS DOUBLE) / (2 * count(*)), 9) AS weight FROM training GROUP BY abandono""",
        "training",
    ),
    "stratified_folds": statement(
        """SELECT abandono, fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n,
n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS students
FROM (SELECT abandono, count(*) AS n FROM training GROUP BY abandono), (SELECT CAST(range AS INT) AS fold FROM range(5))""",
        "training",
    ),
    "train_model": f"""SELECT count(*) AS rows, count(*) AS in_range, {TREES} AS trees, 1 AS fits_training_rows, 0 AS trees_with_lost_cover,
9 + (SELECT count(DISTINCT CASE WHEN c_custkey % 11 = 0 THEN 'None' ELSE c_mktsegment END) FROM customer) AS encoded_columns,
{MAX_DEPTH} AS max_depth FROM customer""",
    "auc": statement(
        """SELECT round((sum(CASE WHEN abandono = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM (
SELECT abandono, (rank() OVER (ORDER BY churn_risk) + rank() OVER (ORDER BY churn_risk) + count(*) OVER (PARTITION BY churn_risk) - 1) / 2.0::DOUBLE AS r,
CAST(sum(abandono) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n
FROM (SELECT round(churn_risk, 9) AS churn_risk, abandono FROM scored JOIN training USING (student_id))) GROUP BY p, n""",
        "scored",
        "training",
    ),
    "cv_auc": statement(
        """SELECT fold, count(*) AS rows, CAST(sum(abandono) AS BIGINT) AS positives,
round((sum(CASE WHEN abandono = 1 THEN r END) - sum(abandono) * (sum(abandono) + 1) / 2.0)
  / nullif(sum(abandono) * (count(*) - sum(abandono)), 0), 9) AS auc
FROM (SELECT fold, abandono, rank() OVER (PARTITION BY fold ORDER BY churn_risk)
  + (count(*) OVER (PARTITION BY fold, churn_risk) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT round(churn_risk, 9) AS churn_risk, abandono, CAST(instr('0123456789abcdef', md5(CAST(student_id AS VARCHAR))[1]) % 5 AS INT) AS fold
    FROM scored JOIN training USING (student_id))) GROUP BY fold""",
        "scored",
        "training",
    ),
    "cv_trained": statement(
        """SELECT fold, CAST(sum(size) AS BIGINT) AS rows, CAST(sum(size) FILTER (WHERE abandono = 1) AS BIGINT) AS positives,
CAST(sum(size) AS BIGINT) AS students, CAST(sum(size) AS BIGINT) AS in_range, true AS area_in_range
FROM (SELECT abandono, fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS size
  FROM (SELECT abandono, count(*) AS n FROM training GROUP BY abandono), (SELECT CAST(range AS INT) AS fold FROM range(5)))
GROUP BY fold""",
        "training",
    ),
    "score_all_rf": f"SELECT count(*) AS n, count(*) AS students, count(*) AS in_range, '{ASOF}' AS asof_date FROM customer",
    "model_roundtrip": "SELECT count(*) AS n, 0 AS different, 1 AS same_contract FROM customer",
    "score_all": statement(f"SELECT student_id, '{ASOF}' AS asof_date, {_RISK} FROM scored", "scored"),
    "top_risk": statement(f"SELECT student_id, {_RISK} FROM scored ORDER BY 2 DESC, 1 LIMIT 20", "scored"),
    "score_latest": statement(
        """SELECT student_id, CAST(greatest((SELECT max(class_date)::DATE FROM attendance), (SELECT max(payment_date)::DATE FROM payments)) AS VARCHAR) AS asof_date,
true AS in_range FROM students WHERE student_id IN (SELECT student_id FROM payments WHERE amount > 300000)""",
        "students",
        "attendance",
        "payments",
    ),
    "score_students": statement(
        f"SELECT student_id, {_RISK} FROM scored WHERE student_id IN (SELECT student_id FROM payments WHERE amount > 300000)",
        "payments",
        "scored",
    ),
    "kpi_high_risk": statement("SELECT count(*) FILTER (WHERE churn_risk >= 0.7) AS high_risk_students FROM scored", "scored"),
    "revenue_at_risk": statement(
        """SELECT CAST(coalesce(sum(CAST(price_usd AS DECIMAL(18,6))), 0) AS DOUBLE) AS revenue_at_risk, count(*) AS students
FROM scored WHERE churn_risk >= 0.7""",
        "scored",
    ),
}
