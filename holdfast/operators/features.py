"""As-of features per student, from history up to the day before the as-of date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import dates, values
from holdfast.operators import membership
from holdfast.session import materialize

# Trailing windows in days, paid statuses, sentinels for "never", the name of a
# missing category.
WINDOWS = (30, 60, 90)
PAYMENT_WINDOW = 90
PAID_STATUSES = ("completed", "paid", "success", "approved", "ok")
NEVER = 9999
MISSING_CATEGORY = "None"
# A key is hot if more than one row in so many has it; so there are fewer hot keys than that.
HOT_SHARE = 256

# The model's columns in order.
FEATURES = [
    "student_id",
    "plan",
    "price_usd",
    "tenure_days",
    "days_since_last_attendance",
    "total_classes_30d",
    "total_classes_60d",
    "total_classes_90d",
    "months_since_last_payment",
    "payments_90d_usd",
    "n_payments_90d",
]
CATEGORICAL = ["plan"]
NUMERIC = [c for c in FEATURES if c not in ("student_id", *CATEGORICAL)]


def infer_asof(attendance: DataFrame, payments: DataFrame) -> DataFrame:
    """One row with the later of the last attendance and last payment day; an error if there is none."""
    latest = attendance.select(F.max("class_date").cast("date").alias("day")).unionByName(
        payments.select(F.max("payment_date").cast("date").alias("day"))
    )
    day = F.max("day")
    missing = F.raise_error(F.lit("no dates in attendance or payments")).cast("date")
    return latest.agg(F.coalesce(day, missing).alias("asof_date"))


def asof_or_inferred(asof: str | dt.date | None, attendance: DataFrame, payments: DataFrame) -> dt.date:
    if asof is not None:
        return dates.as_date(asof)
    return infer_asof(attendance, payments).first()["asof_date"]


def until_cutoff(df: DataFrame, date_column: str, asof: str | dt.date) -> DataFrame:
    """Rows dated up to 00:00 of the day before the as-of date."""
    return df.filter(F.col(date_column) <= dates.midnight(df, date_column, dates.cutoff_of(asof)))


def in_window(df: DataFrame, date_column: str, asof: str | dt.date, days: int) -> Column:
    """True for dates in the N days that end with the cutoff day, both ends included."""
    cutoff = dates.cutoff_of(asof)
    first = cutoff - dt.timedelta(days=days - 1)
    return F.col(date_column).between(
        dates.midnight(df, date_column, first), dates.midnight(df, date_column, cutoff)
    )


def paid_only(payments: DataFrame, statuses: Sequence[str] = PAID_STATUSES) -> DataFrame:
    """Payments with a paid status in any case; no status counts as paid."""
    return payments.filter(F.coalesce(F.lower("status"), F.lit("paid")).isin(*statuses))


def attendance_features(
    attendance: DataFrame,
    asof: str | dt.date,
    windows: Sequence[int] = WINDOWS,
    present_only: bool = False,
) -> DataFrame:
    """Last class and attended classes per trailing window, in one aggregation of the history.

    ``last_class`` counts absences too unless ``present_only``.
    """
    history = until_cutoff(attendance, "class_date", asof)
    present = F.coalesce(F.col("present"), F.lit(1)).cast("bigint")
    dated = F.when(present == 1, F.col("class_date")) if present_only else F.col("class_date")
    return history.groupBy("student_id").agg(
        F.max(dated).alias("last_class"),
        *[
            F.sum(F.when(in_window(history, "class_date", asof, n), present).otherwise(0)).alias(f"total_classes_{n}d")
            for n in windows
        ],
    )


def payment_features(
    payments: DataFrame,
    asof: str | dt.date,
    window: int = PAYMENT_WINDOW,
    statuses: Sequence[str] = PAID_STATUSES,
) -> DataFrame:
    """Last paid payment, and amount and number of paid payments in the trailing window."""
    history = paid_only(until_cutoff(payments, "payment_date", asof), statuses)
    recent = in_window(history, "payment_date", asof, window)
    return history.groupBy("student_id").agg(
        F.max("payment_date").alias("last_payment"),
        F.coalesce(F.sum(F.when(recent, F.col("amount"))), F.lit(0)).alias(f"payments_{window}d_usd"),
        F.count(F.when(recent, F.col("payment_id"))).alias(f"n_payments_{window}d"),
    )


def student_base(students: DataFrame, asof: str | dt.date, keep: Sequence[str] = ()) -> DataFrame:
    """Per student row: cleaned plan and price, and whole days since signup (0 if unknown or later)."""
    tenure = dates.whole_days(dates.cutoff_of(asof), dates.lenient_timestamp(students, "signup_date"))
    return students.select(
        "student_id",
        *keep,
        F.coalesce(F.col("plan").cast("string"), F.lit(MISSING_CATEGORY)).alias("plan"),
        values.number_or_zero(
            F.col("price_usd"), text=not isinstance(students.schema["price_usd"].dataType, T.NumericType)
        ).alias("price_usd"),
        F.greatest(F.lit(0), F.coalesce(tenure, F.lit(0))).cast("bigint").alias("tenure_days"),
    )


def days_since(asof: str | dt.date, last: Column) -> Column:
    return F.coalesce(dates.whole_days(dates.cutoff_of(asof), last.cast("timestamp_ntz")), F.lit(NEVER))


def months_since(asof: str | dt.date, last: Column) -> Column:
    days = dates.whole_days(dates.cutoff_of(asof), last.cast("timestamp_ntz"))
    return F.coalesce(days.cast("double") / F.lit(30.0), F.lit(float(NEVER)))


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> tuple[list, bool]:
    """The keys that more than one row in ``share`` has, by a sketch of fixed size, and whether NULL is one.

    The sketch overestimates at most, by less than a tenth of the share, so it misses no hot key; one too many does no harm.
    """
    tracked = share * 64
    top = F.call_function("approx_top_k", F.col(key), F.lit(share), F.lit(tracked))
    found = df.select(key).agg(top.alias("top"), F.count(F.lit(1)).alias("rows"), F.count(key).alias("filled")).first()
    hot = [x["item"] for x in found.top or [] if x["item"] is not None and x["count"] * share > found.rows]
    return hot, (found.rows - found.filled) * share > found.rows


def spread_joins(base: DataFrame, sides: Sequence[DataFrame], key: str, salt: str, hot: Sequence, parts: int) -> DataFrame:
    """Left joins on a key that some of ``base`` share too often: its ``salt`` deals them to ``parts`` parts.

    Only the hot keys' rows of the sides, one each, are copied to all parts. ``salt`` is dropped.
    """
    numbers = F.sequence(F.lit(0), F.lit(parts - 1))
    out = base
    for side in sides:
        copies = F.when(F.col(key).isin(*hot), numbers).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        out = out.join(side.withColumn(salt, F.explode(copies)), [key, salt], "left")
    return out.drop(salt)


def student_features(
    students: DataFrame,
    attendance: DataFrame,
    payments: DataFrame,
    asof: str | dt.date,
    hot: tuple[Sequence, bool] | None = None,
) -> DataFrame:
    """The model's feature row per student row.

    Both histories are aggregated by student before the joins, so only partial sums are shuffled and
    a student with a large share of the history costs no more than any other. Ids that a large share of ``students``
    has, NULL among them, are found by a sketch of the id column unless ``hot`` names them (see `hot_keys`); their rows are dealt to
    all partitions by a hash of the whole row, and only their sums are copied there.
    """
    aggregates = [attendance_features(attendance, asof), payment_features(payments, asof)]
    return _feature_rows(students, aggregates, asof, hot)


def _feature_rows(students: DataFrame, aggregates: Sequence[DataFrame], asof: str | dt.date, hot: tuple[Sequence, bool] | None) -> DataFrame:
    """Feature rows from the students and what their histories came to."""
    keys, nulls = hot_keys(students, "student_id") if hot is None else hot
    if keys or nulls:
        salt, parts = "_salt", int(students.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shared = F.col("student_id").isNull()
        if keys:
            shared = shared | F.col("student_id").isin(*keys)
        drawn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in students.columns]), F.lit(parts)).cast("int")
        salted = students.withColumn(salt, F.when(shared, drawn).otherwise(0))
        joined = spread_joins(student_base(salted, asof, [salt]), aggregates, "student_id", salt, keys, parts)
    else:
        joined = student_base(students, asof)
        for side in aggregates:
            joined = joined.join(side, "student_id", "left")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return joined.select(
        "student_id",
        "plan",
        "price_usd",
        "tenure_days",
        days_since(asof, F.col("last_class")).cast("bigint").alias("days_since_last_attendance"),
        *[filled(f"total_classes_{n}d").cast("bigint").alias(f"total_classes_{n}d") for n in WINDOWS],
        months_since(asof, F.col("last_payment")).alias("months_since_last_payment"),
        filled("payments_90d_usd").cast("double").alias("payments_90d_usd"),
        filled("n_payments_90d").cast("bigint").alias("n_payments_90d"),
    )


def only_students(df: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Rows of the wanted students; a list becomes a scan filter, a table a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("student_id"), "student_id", "left_semi")
    return df.filter(F.col("student_id").isin(*ids))


def unknown_students(ids: DataFrame, students: DataFrame) -> DataFrame:
    """Wanted ids that are no students."""
    return ids.select("student_id").join(students.select("student_id"), "student_id", "left_anti")


def features_of(
    ids: DataFrame | Sequence[int],
    students: DataFrame,
    attendance: DataFrame,
    payments: DataFrame,
    asof: str | dt.date,
) -> DataFrame:
    """Features of chosen students. Listed ids filter the scans.

    Ids in a table filter the students exactly; both histories are thinned out at their scans by a Bloom filter of the
    ids, then aggregated, so a student with much history is never shuffled row by row. What the filter lets
    through by mistake finds no student to join.
    """
    if isinstance(ids, DataFrame):
        wanted = materialize(ids.select("student_id").where("student_id IS NOT NULL").distinct())
        n = wanted.count()
        histories = [membership.possible(h, "student_id", wanted, "student_id", n) for h in (attendance, payments)]
        return student_features(only_students(students, wanted), *histories, asof)
    return student_features(
        only_students(students, ids), only_students(attendance, ids), only_students(payments, ids), asof
    )


def align_features(
    df: DataFrame,
    feature_order: Sequence[str],
    categorical: Sequence[str] = (),
    numeric: Sequence[str] = (),
    keep: Sequence[str] = ("student_id",),
) -> DataFrame:
    """Columns of the model contract in order; absent ones are 0, numbers are doubles without NULLs.

    ``keep`` carries key columns in front that are not part of the contract.
    """
    out = [F.col(c) for c in keep if c in df.columns and c not in feature_order]
    for name in feature_order:
        c = F.col(f"`{name}`") if name in df.columns else F.lit(0)
        if name in categorical:
            c = F.coalesce(c.cast("string"), F.lit(MISSING_CATEGORY))
        elif name in numeric:
            is_number = name not in df.columns or isinstance(df.schema[name].dataType, T.NumericType)
            c = values.number_or_zero(c, text=not is_number)
        out.append(c.alias(name))
    return df.select(*out)


# Histories as daily partial sums. Partials of any days, in any order and number, add up: new days are appended, and every
# as-of day is answered from them. A history up to 00:00 of the cutoff day needs that day's midnight rows apart.


def _at_midnight(column: str) -> Column:
    stamp = F.col(column).cast("timestamp_ntz")
    return stamp == F.date_trunc("DAY", stamp)


def daily_attendance(attendance: DataFrame) -> DataFrame:
    """(student_id, day, latest, classes, midnight_rows, midnight_classes) per student and day."""
    present, midnight = F.coalesce(F.col("present"), F.lit(1)).cast("bigint"), _at_midnight("class_date")
    dated = attendance.where(F.col("class_date").isNotNull())
    return dated.groupBy("student_id", F.col("class_date").cast("date").alias("day")).agg(
        F.max(F.col("class_date").cast("timestamp_ntz")).alias("latest"),
        F.sum(present).alias("classes"),
        F.count_if(midnight).alias("midnight_rows"),
        F.sum(F.when(midnight, present).otherwise(0)).alias("midnight_classes"),
    )


def daily_payments(payments: DataFrame, statuses: Sequence[str] = PAID_STATUSES) -> DataFrame:
    """(student_id, day, latest, amount, payments, and the same at midnight) of the paid payments per student and day."""
    midnight = _at_midnight("payment_date")
    dated = paid_only(payments, statuses).where(F.col("payment_date").isNotNull())
    return dated.groupBy("student_id", F.col("payment_date").cast("date").alias("day")).agg(
        F.max(F.col("payment_date").cast("timestamp_ntz")).alias("latest"),
        F.sum("amount").alias("amount"),
        F.count("payment_id").alias("payments"),
        F.count_if(midnight).alias("midnight_rows"),
        F.sum(F.when(midnight, F.col("amount"))).alias("midnight_amount"),
        F.count(F.when(midnight, F.col("payment_id"))).alias("midnight_payments"),
    )


def extend_daily(partials: DataFrame, path: str) -> None:
    """Add the partials of new rows to a kept table, a folder per month; earlier files stay as they are."""
    month = (F.year("day") * 100 + F.month("day")).alias("month")
    partials.select("*", month).write.mode("append").partitionBy("month").parquet(path)


def read_daily(spark: SparkSession, path: str, until: dt.date | None = None) -> DataFrame:
    """The kept partials; only the months up to a day are read."""
    kept = spark.read.parquet(path)
    return kept if until is None else kept.where((F.col("month") <= until.year * 100 + until.month) & (F.col("day") <= F.lit(until)))


def _last_until(cutoff: dt.date) -> Column:
    """The latest time up to 00:00 of the cutoff day."""
    midnight = F.lit(cutoff).cast("timestamp_ntz")
    return F.max(F.when(F.col("day") < F.lit(cutoff), F.col("latest")).when(F.col("midnight_rows") > 0, midnight))


def _days(cutoff: dt.date, days: int, whole: str, midnight: str) -> Column:
    """A daily value of the trailing days: whole days before the cutoff day, and what that day has at midnight."""
    first = F.lit(cutoff - dt.timedelta(days=days - 1))
    day = F.col("day")
    return F.when((day >= first) & (day < F.lit(cutoff)), F.col(whole)).when(day == F.lit(cutoff), F.col(midnight))


def features_from_daily(
    students: DataFrame,
    attendance: DataFrame,
    payments: DataFrame,
    asof: str | dt.date,
    hot: tuple[Sequence, bool] | None = None,
) -> DataFrame:
    """`student_features` from daily partials instead of histories."""
    cutoff = dates.cutoff_of(asof)
    seen = attendance.where(F.col("day") <= F.lit(cutoff)).groupBy("student_id")
    paid = payments.where(F.col("day") <= F.lit(cutoff)).groupBy("student_id")
    aggregates = [
        seen.agg(
            _last_until(cutoff).alias("last_class"),
            *[F.coalesce(F.sum(_days(cutoff, n, "classes", "midnight_classes")), F.lit(0)).alias(f"total_classes_{n}d") for n in WINDOWS],
        ),
        paid.agg(
            _last_until(cutoff).alias("last_payment"),
            F.coalesce(F.sum(_days(cutoff, PAYMENT_WINDOW, "amount", "midnight_amount")), F.lit(0)).alias(f"payments_{PAYMENT_WINDOW}d_usd"),
            F.coalesce(F.sum(_days(cutoff, PAYMENT_WINDOW, "payments", "midnight_payments")), F.lit(0)).alias(f"n_payments_{PAYMENT_WINDOW}d"),
        ),
    ]
    return _feature_rows(students, aggregates, asof, hot)
