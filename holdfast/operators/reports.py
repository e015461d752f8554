"""Reports for the school's staff."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import dates
from holdfast.functions.risk import risk_tier
from holdfast.functions.text import contains_ignoring_case, initials
from holdfast.operators.features import paid_only, until_cutoff


def high_risk_count(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if(risk_tier(F.col("churn_risk")) == "high").alias("high_risk_students"))


def revenue_at_risk(scores: DataFrame) -> DataFrame:
    """Sum of the prices of high-tier students; ``scores`` has churn_risk and price_usd."""
    price = F.col("price_usd").cast("decimal(18,6)")
    high = risk_tier(F.col("churn_risk")) == "high"
    return scores.agg(
        F.coalesce(F.sum(F.when(high, price)), F.lit(0)).cast("double").alias("revenue_at_risk"),
        F.count_if(high).alias("students"),
    )


def month_bounds(day: str | dt.date) -> tuple[dt.date, dt.date]:
    first = dates.as_date(day).replace(day=1)
    return first, (first + dt.timedelta(days=32)).replace(day=1)


def between_days(df: DataFrame, column: str, first: dt.date, end: dt.date) -> DataFrame:
    """Rows in [first, end)."""
    c = F.col(column)
    return df.filter((c >= dates.midnight(df, column, first)) & (c < dates.midnight(df, column, end)))


def month_revenue(payments: DataFrame, asof: str | dt.date) -> DataFrame:
    """Paid revenue in the calendar month of a day."""
    paid = between_days(paid_only(payments), "payment_date", *month_bounds(asof))
    return paid.agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("month_revenue"),
        F.count(F.lit(1)).alias("payments"),
    )


def income_by_month(payments: DataFrame) -> DataFrame:
    month = F.date_format(F.col("payment_date").cast("date"), "yyyy-MM").alias("month")
    return (
        paid_only(payments)
        .groupBy(month)
        .agg(F.sum("amount").cast("double").alias("income"), F.count(F.lit(1)).alias("payments"))
        .orderBy("month")
    )


def delinquents(students: DataFrame, payments: DataFrame, first: dt.date | str, end: dt.date | str) -> DataFrame:
    """Students without a paid payment in [first, end). Payers are made distinct per task before the shuffle."""
    payers = between_days(paid_only(payments), "payment_date", dates.as_date(first), dates.as_date(end))
    return students.join(payers.select("student_id").distinct(), "student_id", "left_anti")


def active_students(enrollments: DataFrame, students: DataFrame, course: str | None = None) -> DataFrame:
    active = enrollments.filter(F.col("is_active"))
    if course is not None:
        active = active.filter(F.col("course") == course)
    return active.select("student_id", "course").join(
        students.select("student_id", "name", "plan"), "student_id"
    )


def course_calendar(sessions: DataFrame, course_id: int | None = None) -> DataFrame:
    rows = sessions if course_id is None else sessions.filter(F.col("course_id") == course_id)
    return rows.orderBy("course_id", "class_date")


def attendance_by_class(attendance: DataFrame) -> DataFrame:
    """Present and absent counts per session; a missing mark counts as present."""
    present = F.coalesce(F.col("present"), F.lit(1))
    return attendance.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("students"),
        F.count_if(present == 1).alias("present"),
        F.count_if(present == 0).alias("absent"),
    )


def duplicate_emails(students: DataFrame) -> DataFrame:
    """E-mails (case and outer blanks aside) that more than one row has; blank ones are no e-mail."""
    key = F.nullif(F.lower(F.trim("email")), F.lit(""))
    return (
        students.select(key.alias("email"))
        .filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def filter_students(
    df: DataFrame, course: str | None = None, tier: str | None = None, text: str = ""
) -> DataFrame:
    """Students of a course and tier (all if not given) whose name or e-mail contains a text."""
    out = df
    if course is not None:
        out = out.filter(F.col("course") == course)
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    if text:
        out = out.filter(
            contains_ignoring_case(F.col("name"), text) | contains_ignoring_case(F.col("email"), text)
        )
    return out


def top_drivers(explained: DataFrame, top_k: int | None = None) -> DataFrame:
    """Share of students per strongest reason; ``explained`` has ``reasons``, strongest first."""
    counts = (
        explained.select(F.get("reasons", F.lit(0))["feature"].alias("driver"))
        .filter(F.col("driver").isNotNull())
        .groupBy("driver")
        .agg(F.count(F.lit(1)).alias("students"))
    )
    # One row per model feature is left here, so one window over all of them is small.
    total = F.sum("students").over(Window.partitionBy(F.lit(1)))
    shares = counts.withColumn("share", F.col("students") / total)
    ordered = shares.orderBy(F.desc("students"), "driver")
    return ordered if top_k is None else ordered.limit(top_k)


# What the list says of a tier.
TIER_STATUS = {"high": "At risk", "medium": "Overdue", "low": "OK"}


def last_payments(payments: DataFrame, asof: str | dt.date) -> DataFrame:
    """(student_id, last_payment): the day of the last paid payment up to the cutoff day."""
    paid = paid_only(until_cutoff(payments, "payment_date", asof))
    return paid.groupBy("student_id").agg(F.max("payment_date").cast("date").alias("last_payment"))


def prioritized_list(explained: DataFrame, students: DataFrame, last_paid: DataFrame) -> DataFrame:
    """Student list by risk with contact, reasons, price, last payment, tier and status.

    ``explained`` carries churn_risk, reasons and the feature columns of the same row; ``last_paid`` is that of
    `last_payments`. ``reasons`` names all reasons, strongest first; ``reason`` is the first of them.
    """
    tier = risk_tier(F.col("churn_risk"))
    status = F.lit(None).cast("string")
    for name, text in TIER_STATUS.items():
        status = F.when(tier == name, text).otherwise(status)
    listed = explained.select(
        "student_id",
        "churn_risk",
        F.get("reasons", F.lit(0))["feature"].alias("reason"),
        F.array_join(F.transform("reasons", lambda r: r["feature"]), ", ").alias("reasons"),
        "price_usd",
        "months_since_last_payment",
        tier.alias("tier"),
        status.alias("status"),
    )
    return (
        listed.join(students.select("student_id", "name", initials(F.col("name")).alias("initials"), "email"), "student_id")
        .join(last_paid, "student_id", "left")
        .orderBy(F.desc("churn_risk"), "student_id")
    )
