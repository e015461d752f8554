"""As-of features and the expressions they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import dates, risk, text, values
from holdfast.operators import features, messages
from holdfast.session import work_path
from workload.model import feature_rows
from workload.oracle import PAID, days, statement
from workload.pinned import CONTRACT
from workload.tables import ASOF, CUTOFF, EARLIER_ASOF, EARLIER_CUTOFF, EVENTS_ASOF, core, view


def infer_asof(spark, sf_dir):
    _, attendance, payments = core(spark, sf_dir)
    return features.infer_asof(attendance, payments).select(F.col("asof_date").cast("string").alias("asof_date"))


def tenure(spark, sf_dir):
    return features.student_base(view(spark, sf_dir, "students"), ASOF).select("student_id", "tenure_days")


def price_clean(spark, sf_dir):
    rows = view(spark, sf_dir, "students")
    return rows.select("student_id", values.number_or_zero(F.col("price_usd")).alias("price_usd"))


def recency(spark, sf_dir):
    """As of the inferred day and on the table with times of day."""
    history = features.until_cutoff(view(spark, sf_dir, "attendance_ts"), "class_date", EVENTS_ASOF)
    last = history.groupBy("student_id").agg(F.max("class_date").alias("last_class"))
    students = view(spark, sf_dir, "contacts").select("student_id")
    joined = students.join(last, "student_id", "left")
    return joined.select(
        "student_id",
        features.days_since(EVENTS_ASOF, F.col("last_class")).cast("bigint").alias("days_since_last"),
        F.round(features.months_since(EVENTS_ASOF, F.col("last_class")), 6).alias("months_since_last"),
    )


def asof_filter(spark, sf_dir):
    kept = features.until_cutoff(view(spark, sf_dir, "attendance_ts"), "class_date", EVENTS_ASOF)
    return kept.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("class_date"), "yyyy-MM-dd HH:mm:ss").alias("last_class")
    )


def paid_payments(spark, sf_dir):
    paid = features.paid_only(view(spark, sf_dir, "payments"))
    return paid.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount")
    )


def attendance_features(spark, sf_dir):
    _, attendance, _ = core(spark, sf_dir)
    return features.attendance_features(attendance, ASOF).withColumn("last_class", F.col("last_class").cast("date").cast("string"))


def payment_features(spark, sf_dir):
    _, _, payments = core(spark, sf_dir)
    return features.payment_features(payments, ASOF).select(
        "student_id",
        F.col("last_payment").cast("date").cast("string").alias("last_payment"),
        F.col("payments_90d_usd").cast("double").alias("payments_90d_usd"),
        "n_payments_90d",
    )


def student_features(spark, sf_dir):
    return feature_rows(spark, sf_dir).withColumn("months_since_last_payment", F.round("months_since_last_payment", 6))


def features_incremental(spark, sf_dir):
    """Two as-of days from one table of daily partials, which was written in two goes, the later days first."""
    students, attendance, payments = core(spark, sf_dir)
    folder, middle = work_path(spark, "daily"), F.lit("1999-01-01").cast("date")
    for name, rows, column in (("attendance", attendance, "class_date"), ("payments", payments, "payment_date")):
        daily = features.daily_attendance if name == "attendance" else features.daily_payments
        for part in (F.col(column) >= middle, F.col(column) < middle):
            features.extend_daily(daily(rows.where(part)), f"{folder}/{name}")
    out = None
    for asof in (ASOF, EARLIER_ASOF):
        kept = [features.read_daily(spark, f"{folder}/{n}", dates.cutoff_of(asof)) for n in ("attendance", "payments")]
        rows = features.features_from_daily(students, *kept, asof).withColumn("asof_date", F.lit(asof))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("months_since_last_payment", F.round("months_since_last_payment", 6))


def align_features(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).drop("total_classes_60d").withColumn("price_usd", F.col("price_usd").cast("string"))
    out = features.align_features(
        rows, [*CONTRACT["feature_order"], "referrals"], CONTRACT["categorical_cols"], [*CONTRACT["numeric_cols"], "referrals"]
    )
    return out.withColumn("months_since_last_payment", F.round("months_since_last_payment", 6))


def unknown_students(spark, sf_dir):
    ids = view(spark, sf_dir, "payments").select((F.col("student_id") * 2).alias("student_id")).distinct()
    return features.unknown_students(ids, view(spark, sf_dir, "contacts"))


def risk_tier(spark, sf_dir):
    rows, p = view(spark, sf_dir, "records"), F.nanvl("prob_churn", F.lit(None))
    return rows.groupBy(risk.risk_tier(F.col("prob_churn")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("least"), F.max(p).alias("most")
    )


def contact_fields(spark, sf_dir):
    rows = view(spark, sf_dir, "contacts").select(
        "student_id",
        F.when(F.col("student_id") % 7 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(F.col("student_id") % 14 == 0, F.lit(None)).otherwise(F.lower("name")).alias("customer_name"),
        "email",
        F.concat(F.lit(" other"), F.col("student_id").cast("string"), F.lit("@example.org ")).alias("customer_email"),
    )
    return rows.select("student_id", messages.contact_name(rows).alias("name"), messages.contact_email(rows).alias("email"))


def reason_labels(spark, sf_dir):
    label = text.reason_label(F.col("feature"))
    return view(spark, sf_dir, "reasons").groupBy("feature", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def idempotency_key(spark, sf_dir):
    rows = view(spark, sf_dir, "records")
    return rows.select("record_id", risk.idempotency_key(F.col("student_id"), F.col("asof_date")).alias("idempotency_key"))


def offer_policy(spark, sf_dir):
    rows = view(spark, sf_dir, "records")
    offer = risk.offer_policy(risk.risk_tier(F.col("prob_churn")))
    return rows.select("record_id", offer.alias("o")).select("record_id", "o.eligible", "o.code", "o.discount")


def initials(spark, sf_dir):
    rows = view(spark, sf_dir, "contacts")
    full = F.concat(F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" "), F.coalesce("plan", F.lit("x")))
    return rows.select("student_id", text.initials(full).alias("initials"))


QUERIES = {
    "infer_asof": infer_asof,
    "tenure": tenure,
    "price_clean": price_clean,
    "recency": recency,
    "asof_filter": asof_filter,
    "paid_payments": paid_payments,
    "attendance_features": attendance_features,
    "payment_features": payment_features,
    "student_features": student_features,
    "features_incremental": features_incremental,
    "align_features": align_features,
    "unknown_students": unknown_students,
    "risk_tier": risk_tier,
    "contact_fields": contact_fields,
    "reason_labels": reason_labels,
    "idempotency_key": idempotency_key,
    "offer_policy": offer_policy,
    "initials": initials,
}

_MONTHS = "round(months_since_last_payment, 6) AS months_since_last_payment"
_TIER = "CASE WHEN prob_churn IS NULL OR isnan(prob_churn) THEN 'low' WHEN prob_churn >= 0.7 THEN 'high' WHEN prob_churn >= 0.4 THEN 'medium' ELSE 'low' END"

ORACLES = {
    "infer_asof": """SELECT CAST(greatest((SELECT max(l_shipdate)::DATE FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
(SELECT max(o_orderdate)::DATE FROM orders)) AS VARCHAR) AS asof_date""",
    "tenure": statement("SELECT student_id, tenure_days FROM features", "features"),
    "price_clean": statement("SELECT student_id, coalesce(TRY_CAST(price_usd AS DOUBLE), 0) AS price_usd FROM students", "students"),
    "recency": statement(
        f"""SELECT c_custkey AS student_id, coalesce({days("m", "2024-01-30")}, 9999) AS days_since_last,
round(coalesce(CAST({days("m", "2024-01-30")} AS DOUBLE) / 30.0, 9999.0), 6) AS months_since_last
FROM customer LEFT JOIN (SELECT student_id, max(class_date) AS m FROM attendance_ts
WHERE class_date <= DATE '2024-01-30' GROUP BY student_id) ON student_id = c_custkey""",
        "attendance_ts",
    ),
    "asof_filter": statement(
        """SELECT student_id, count(*) AS n, strftime(max(class_date), '%Y-%m-%d %H:%M:%S') AS last_class FROM attendance_ts
WHERE class_date <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY student_id""",
        "attendance_ts",
    ),
    "paid_payments": statement(
        f"""SELECT coalesce(status, 'none') AS status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
FROM payments WHERE {PAID} GROUP BY 1""",
        "payments",
    ),
    "attendance_features": statement(
        """SELECT student_id, CAST(CAST(latest AS DATE) AS VARCHAR) AS last_class, CAST(coalesce(days_30, 0) AS BIGINT) AS total_classes_30d,
CAST(coalesce(days_60, 0) AS BIGINT) AS total_classes_60d, CAST(coalesce(days_90, 0) AS BIGINT) AS total_classes_90d FROM classes""",
        "classes",
    ),
    "payment_features": statement(
        """SELECT student_id, CAST(CAST(latest AS DATE) AS VARCHAR) AS last_payment,
CAST(coalesce(amount, 0) AS DOUBLE) AS payments_90d_usd, payments AS n_payments_90d FROM income""",
        "income",
    ),
    "student_features": statement(f"SELECT * REPLACE ({_MONTHS}) FROM features", "features"),
    "features_incremental": statement(f"SELECT * REPLACE ({_MONTHS}), '{ASOF}' AS asof_date FROM features", "features")
    + " UNION ALL ("
    + statement(f"SELECT * REPLACE ({_MONTHS}), '{EARLIER_ASOF}' AS asof_date FROM features", "features").replace(CUTOFF, EARLIER_CUTOFF)
    + ")",
    "align_features": statement(
        f"""SELECT student_id, plan, price_usd, CAST(tenure_days AS DOUBLE) AS tenure_days,
CAST(days_since_last_attendance AS DOUBLE) AS days_since_last_attendance, CAST(total_classes_30d AS DOUBLE) AS total_classes_30d,
0.0::DOUBLE AS total_classes_60d, CAST(total_classes_90d AS DOUBLE) AS total_classes_90d, {_MONTHS}, payments_90d_usd,
CAST(n_payments_90d AS DOUBLE) AS n_payments_90d, 0.0::DOUBLE AS referrals FROM features""",
        "features",
    ),
    "unknown_students": """SELECT DISTINCT o_custkey * 2 AS student_id FROM orders
WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""",
    "risk_tier": statement(
        f"""SELECT {_TIER} AS tier, count(*) AS n, min(prob_churn) FILTER (WHERE NOT isnan(prob_churn)) AS least,
max(prob_churn) FILTER (WHERE NOT isnan(prob_churn)) AS most FROM records GROUP BY 1""",
        "records",
    ),
    "contact_fields": statement(
        """SELECT student_id, CASE WHEN student_id % 14 = 0 THEN 'Customer' WHEN student_id % 7 = 0 THEN lower(name) ELSE name END AS name,
CASE WHEN email IS NULL THEN 'other' || student_id || '@example.org' WHEN trim(email) = '' THEN NULL ELSE trim(email) END AS email
FROM contacts""",
        "contacts",
    ),
    "reason_labels": statement(
        """SELECT feature, CASE feature WHEN 'plan' THEN 'plan_inadecuado' WHEN 'price_usd' THEN 'precio_alto'
WHEN 'payments_90d_usd' THEN 'bajo_pago_reciente' WHEN 'days_since_last_attendance' THEN 'inactividad_reciente'
ELSE feature END AS label, count(*) AS n FROM reasons GROUP BY 1, 2""",
        "reasons",
    ),
    "idempotency_key": statement(
        """SELECT record_id, concat_ws('|', student_id, nullif(asof_date, '')) AS idempotency_key FROM records""",
        "records",
    ),
    "offer_policy": statement(
        f"""SELECT record_id, t <> 'low' AS eligible, CASE WHEN t <> 'low' THEN 'SAVE10' END AS code,
CASE WHEN t <> 'low' THEN 10 ELSE 0 END AS discount
FROM (SELECT record_id, {_TIER} AS t FROM records)""",
        "records",
    ),
    "initials": """SELECT c_custkey AS student_id, 'C' || substr(split_part(c_name, '#', 2), 1, 1) AS initials FROM customer""",
}
