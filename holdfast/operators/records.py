"""Explanation records: normalisation, rejection and candidate selection.

A record has ``customer_id`` and/or ``student_id``, ``asof_date``, ``prob_churn`` and ``reasons``, an
array of (feature, impact, effect, value). Reasons may also come as a table of their own, one row each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.risk import TIER_HIGH, TIER_MEDIUM, risk_tier
from holdfast.functions.text import REASON_LABELS, reason_label
from holdfast.operators.explain import RAISES

# Fixed value: exported reasons per record.
TOP_REASONS = 3


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def record_id(df: DataFrame) -> Column:
    """``customer_id``, or ``student_id`` where it is missing, 0 or empty; NULL if there is no such column."""
    if "customer_id" not in df.columns:
        return F.col("student_id")
    first = F.col("customer_id")
    text = first.cast("string")
    second = F.col("student_id") if "student_id" in df.columns else F.lit(None)
    return F.when(text.isNotNull() & ~text.isin("", "0"), first).otherwise(second)


def is_raiser(effect: Column) -> Column:
    return F.coalesce(F.lower(effect) == RAISES, F.lit(False))


def _impact(raw: Column) -> Column:
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(raw.try_cast("double"))


def top_reasons(reasons: Column, top_k: int = TOP_REASONS, labels: Mapping[str, str] = REASON_LABELS) -> Column:
    """The k risk-raising reasons with the largest impact, ties in their given order, with labels."""
    numbered = F.transform(
        reasons,
        lambda r, i: F.struct(
            (-F.abs(_impact(r["impact"]))).alias("order"),
            i.alias("position"),
            r["feature"].alias("feature"),
            _impact(r["impact"]).alias("impact"),
            r["effect"].alias("effect"),
            r["value"].cast("string").alias("value"),
        ),
    )
    raisers = F.filter(numbered, lambda r: is_raiser(r["effect"]))
    kept = F.transform(
        F.slice(F.array_sort(raisers), 1, top_k),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            reason_label(r["feature"], labels).alias("reason_human"),
            r["impact"].alias("impact"),
            r["value"].alias("value"),
        ),
    )
    return F.coalesce(kept, F.array().cast("array<struct<feature:string,reason_human:string,impact:double,value:string>>"))


def top_reason_rows(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    top_k: int = TOP_REASONS,
    labels: Mapping[str, str] = REASON_LABELS,
) -> DataFrame:
    """``top_reasons`` for reasons kept one per row: (key, top_reasons).

    Spark cuts every key to k rows before the shuffle and again after it, so no task ever holds all
    reasons of a key; only the k kept rows are folded into an array.
    """
    raisers = rows.filter(is_raiser(F.col("effect"))).withColumn("impact", _impact(F.col("impact")))
    strongest = Window.partitionBy(key).orderBy(F.desc(F.abs("impact")), *order)
    best = raisers.withColumn("_place", F.row_number().over(strongest)).filter(F.col("_place") <= top_k)
    item = F.struct(
        "_place",
        F.struct(
            F.col("feature"),
            reason_label(F.col("feature"), labels).alias("reason_human"),
            F.col("impact"),
            F.col("value").cast("string").alias("value"),
        ).alias("reason"),
    )
    return best.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda e: e["reason"]).alias("top_reasons")
    )


def _rejection(df: DataFrame, missing_prob: float) -> tuple[Column, Column]:
    """(probability, reason to drop the record or NULL)."""
    raw = F.col("prob_churn")
    p = F.when(raw.isNull(), F.lit(missing_prob)).otherwise(raw.try_cast("double"))
    in_range = F.coalesce(p.between(0.0, 1.0) & ~F.isnan(p), F.lit(False))
    reason = (
        F.when(p.isNull(), "malformed")
        .when(F.col("_id").isNull(), "missing_id")
        .when(~in_range, "probability_out_of_range")
    )
    return p, reason


def assess_records(df: DataFrame, top_k: int = TOP_REASONS, labels: Mapping[str, str] = REASON_LABELS) -> DataFrame:
    """Normalised records with a ``rejected`` reason (NULL for valid ones).

    ``df`` has either ``reasons`` or, already reduced, ``top_reasons``. A missing probability is 0.
    """
    named = df.withColumn("_id", record_id(df))
    p, rejected = _rejection(named, missing_prob=0.0)
    reasons = top_reasons(F.col("reasons"), top_k, labels) if "reasons" in df.columns else F.col("top_reasons")
    if "reasons" in df.columns:
        bad_impact = F.coalesce(
            F.exists(
                "reasons",
                lambda r: is_raiser(r["effect"]) & r["impact"].isNotNull() & r["impact"].try_cast("double").isNull(),
            ),
            F.lit(False),
        )
        rejected = F.when(bad_impact, "malformed").otherwise(rejected)
    extra = [c for c in df.columns if c not in ("customer_id", "student_id", "asof_date", "prob_churn", "reasons", "top_reasons", "top_k")]
    return named.select(
        F.col("_id").alias("customer_id"),
        "asof_date",
        p.alias("prob_churn"),
        reasons.alias("top_reasons"),
        *extra,
        rejected.alias("rejected"),
    )


def normalize_records(df: DataFrame, top_k: int = TOP_REASONS, labels: Mapping[str, str] = REASON_LABELS) -> DataFrame:
    return assess_records(df, top_k, labels).filter(F.col("rejected").isNull()).drop("rejected")


def rejected_records(df: DataFrame, top_k: int = TOP_REASONS) -> DataFrame:
    return assess_records(df, top_k).filter(F.col("rejected").isNotNull())


def normalize_record_rows(
    records: DataFrame, reasons: DataFrame, key: str, order: Sequence[str], top_k: int = TOP_REASONS
) -> DataFrame:
    """Records and their reasons from two tables, joined on ``key``; reason-less records stay."""
    best = top_reason_rows(reasons, key, order, top_k)
    joined = records.join(best, key, "left")
    kind = "array<struct<feature:string,reason_human:string,impact:double,value:string>>"
    return joined.withColumn("top_reasons", F.coalesce(F.col("top_reasons"), F.array().cast(kind)))


def pick_candidates(df: DataFrame, high: float = TIER_HIGH, medium: float = TIER_MEDIUM) -> DataFrame:
    """Records with a probability in [0, 1] and at least one reason, with their tier."""
    raw = F.col("prob_churn")
    p = raw if isinstance(df.schema["prob_churn"].dataType, T.DoubleType) else raw.try_cast("double")
    kept = df.withColumn("prob_churn", p).filter(
        F.col("prob_churn").between(0.0, 1.0) & ~F.isnan("prob_churn") & (F.size("top_reasons") > 0)
    )
    return kept.withColumn("tier", risk_tier(F.col("prob_churn"), high, medium))
