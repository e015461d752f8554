"""Scoring, explanation and retention messages from the raw tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import dates
from holdfast.operators import explain, features, forest, messages, records, training
from holdfast.plans.ingest import path_exists
from holdfast.sources import models


def aligned(df: DataFrame, contract: dict) -> DataFrame:
    return features.align_features(
        df, contract["feature_order"], contract["categorical_cols"], contract["numeric_cols"]
    )


Model = PipelineModel | forest.Forest


def with_risk(df: DataFrame, model: Model, contract: dict) -> DataFrame:
    """Feature rows in the contract's columns with their churn_risk: by the packed forest, or by Spark's own transform."""
    rows = aligned(df, contract)
    if isinstance(model, forest.Forest):
        return forest.score(explain.encode(rows, contract["numeric_cols"], contract["categories"]), model).drop("x")
    return training.probability(rows, model)


def score_features(df: DataFrame, model: Model, contract: dict, asof: str | dt.date) -> DataFrame:
    """(student_id, asof_date, churn_risk) for feature rows."""
    scored = with_risk(df, model, contract)
    return scored.select("student_id", F.lit(dates.as_date(asof).isoformat()).alias("asof_date"), "churn_risk")


def by_risk(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest risk first; with a limit only the top rows are kept per task before they are merged."""
    ordered = scores.orderBy(F.desc("churn_risk"), "student_id")
    return ordered if limit is None else ordered.limit(limit)


def score_all(
    students: DataFrame,
    attendance: DataFrame,
    payments: DataFrame,
    model: Model,
    contract: dict,
    asof: str | dt.date | None = None,
) -> DataFrame:
    """Scores of all students, as of a day or of the last day in the data."""
    day = features.asof_or_inferred(asof, attendance, payments)
    return by_risk(score_features(features.student_features(students, attendance, payments, day), model, contract, day))


def score_students(
    ids: DataFrame | Sequence[int],
    students: DataFrame,
    attendance: DataFrame,
    payments: DataFrame,
    model: Model,
    contract: dict,
    asof: str | dt.date | None = None,
) -> DataFrame:
    """Scores of chosen students; of the histories only their rows, and few others, get past the scan."""
    day = features.asof_or_inferred(asof, attendance, payments)
    return score_features(features.features_of(ids, students, attendance, payments, day), model, contract, day)


def _packed_folder(path: str) -> str:
    return f"{path}/packed"


def forest_of_bundle(spark: SparkSession, path: str) -> forest.Forest:
    """The forest of a saved model, ready to score and explain: as `pack_bundle` left it, or packed now."""
    if path_exists(spark, f"{_packed_folder(path)}/head/_SUCCESS"):
        return forest.load_forest(spark, _packed_folder(path))
    contract = models.load_contract(spark, path)
    names = explain.encoded_names(contract["numeric_cols"], contract["categories"])
    return forest.build_forest(forest.nodes_of_model(spark, models.forest_folder(spark, path)), names)


def pack_bundle(spark: SparkSession, path: str) -> str:
    """Keep the packed forest beside the model, so that it is packed once per training. A small one needs no keeping."""
    packed = forest_of_bundle(spark, path)
    if not packed.shipped:
        forest.save_forest(packed, _packed_folder(path))
    return path


def explain_features(
    df: DataFrame,
    ensemble: forest.Forest,
    contract: dict,
    top_k: int = 5,
    tasks: int | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score, contributions and top reasons per feature row; ``tasks`` as for the contributions.

    The score is the base and the sum of the contributions, unless ``score`` adds it to the encoded rows.
    """
    encoded = explain.encode(aligned(df, contract), contract["numeric_cols"], contract["categories"])
    if score is None:
        scored = forest.with_score(forest.shap_values(encoded, ensemble, tasks=tasks), ensemble)
    else:
        scored = forest.shap_values(score(encoded), ensemble, tasks=tasks)
    origins = explain.encoded_origins(contract["numeric_cols"], contract["categories"])
    return explain.local_reasons(scored, origins, contract["feature_order"], top_k=top_k)


def explanation_records(explained: DataFrame, asof: str | dt.date, top_k: int = 5) -> DataFrame:
    """Records for the normaliser."""
    return explained.select(
        "student_id",
        F.lit(dates.as_date(asof).isoformat()).alias("asof_date"),
        F.lit(top_k).alias("top_k"),
        F.col("churn_risk").alias("prob_churn"),
        "reasons",
    )


def campaign(explanations: DataFrame, contacts: DataFrame, top_k: int = records.TOP_REASONS) -> DataFrame:
    """Validated messages for explanation records."""
    candidates = records.pick_candidates(records.normalize_records(explanations, top_k))
    payload = messages.message_payload(messages.enrich_contacts(candidates, contacts), top_k)
    return messages.validate_messages(messages.render_messages(payload))
