"""Training table, and one trained model per session and data folder."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import reports, training
from holdfast.operators.features import FEATURES, paid_only, student_features
from holdfast.plans.scoring import aligned, pack_bundle
from holdfast.session import materialize, work_path
from holdfast.sources import models
from workload.tables import ASOF, core

# The library's own forest; only the labelled rows it is fitted on are bounded.
TREES = training.TREES
MAX_DEPTH = training.MAX_DEPTH
TRAIN_ROWS = 500
HORIZON_DAYS = 90

_bundles: dict[tuple[str, str], str] = {}
_loaded: dict[tuple[str, str], tuple[PipelineModel, dict]] = {}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return student_features(*core(spark, sf_dir), ASOF)


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as of a day; the target is 1 for students without a paid payment in the 90 days from it.

    The contact, date and leaking columns are there for the column guard to drop.
    """
    students, attendance, payments = core(spark, sf_dir)
    start = dt.date.fromisoformat(ASOF)
    payers = (
        reports.between_days(paid_only(payments), "payment_date", start, start + dt.timedelta(days=HORIZON_DAYS))
        .select("student_id")
        .distinct()
        .withColumn("_paid", F.lit(1))
    )
    extra = students.select("student_id", "email", "signup_date")
    return (
        student_features(students, attendance, payments, ASOF)
        .join(extra, "student_id")
        .join(payers, "student_id", "left")
        .select(
            *FEATURES,
            "email",
            "signup_date",
            F.col("n_payments_90d").alias("is_active"),
            F.col("total_classes_90d").alias("update_count"),
            F.when(F.col("_paid").isNull(), 1).otherwise(0).alias("abandono"),
        )
    )


def model_columns(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("student_id", "customer_id")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded sample of labelled rows that the model is fitted on."""
    return training.bounded_rows(model_columns(training_table(spark, sf_dir)), "customer_id", TRAIN_ROWS)


def train_bundle(spark: SparkSession, sf_dir: str, trees: int = TREES, max_depth: int = MAX_DEPTH) -> str:
    model, contract = training.train(training_rows(spark, sf_dir), trees=trees, max_depth=max_depth)
    return pack_bundle(spark, models.save_bundle(spark, model, contract, work_path(spark, "model")))


def bundle(spark: SparkSession, sf_dir: str, anew: bool = False) -> str:
    """Folder of the saved model; trained once per session and data folder, or anew."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if anew or key not in _bundles:
        _bundles[key] = train_bundle(spark, sf_dir)
    return _bundles[key]


def loaded(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A saved model, read once per session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _loaded:
        _loaded[key] = models.load_bundle(spark, path)
    return _loaded[key]


def aligned_rows(spark: SparkSession, sf_dir: str, contract: dict) -> DataFrame:
    return aligned(materialize(training.dealt(feature_rows(spark, sf_dir))), contract)
