"""The school's tables as views over the given tables.

The view texts run unchanged in Spark SQL and in the SQL engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ASOF = "2001-01-01"
CUTOFF = "2000-12-31"
EARLIER_ASOF = "1998-07-15"
EARLIER_CUTOFF = "1998-07-14"
EVENTS_ASOF = "2024-01-31"

BASE = ["customer", "orders", "lineitem", "events"]

VIEWS = {
    "students": """
SELECT c_custkey AS student_id, c_name AS name,
       CASE WHEN c_custkey % 17 = 0 THEN '   ' WHEN c_custkey % 19 = 0 THEN NULL
            ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS plan,
       CASE WHEN c_custkey % 13 = 0 THEN 'n/a'
            ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS price_usd,
       CASE WHEN c_custkey % 23 = 0 THEN 'unknown' ELSE CAST(CAST(f.d AS DATE) AS STRING) END AS signup_date,
       'C' || CAST(c_nationkey AS STRING) AS course
FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM {orders} GROUP BY o_custkey) f
  ON f.o_custkey = c_custkey""",
    "contacts": """
SELECT c_custkey AS student_id, c_name AS name,
       CASE WHEN c_custkey % 17 = 0 THEN '   ' WHEN c_custkey % 19 = 0 THEN NULL
            ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS plan,
       'C' || CAST(c_nationkey AS STRING) AS course
FROM {customer}""",
    "attendance": """
SELECT o_custkey AS student_id, l_shipdate AS class_date, l_suppkey AS session_id,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS present
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "payments": """
SELECT o_orderkey AS payment_id, o_custkey AS student_id, o_orderdate AS payment_date,
       CAST(o_totalprice AS DECIMAL(18,6)) AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'pending' END AS status
FROM {orders}""",
    "attendance_ts": """
SELECT user_id AS student_id, ts AS class_date,
       CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN NULL ELSE 1 END AS present
FROM {events}""",
    "records": """
SELECT o_orderkey AS record_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_custkey END AS student_id,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '' ELSE '2000-12-31' END AS asof_date,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN CAST(1.5 AS DOUBLE)
            WHEN o_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE CAST(o_orderkey % 1000 AS DOUBLE) / 1000 END AS prob_churn
FROM {orders}""",
    "reasons": """
SELECT l_orderkey AS record_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CASE l_linenumber % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'price_usd' WHEN 2 THEN 'payments_90d_usd'
            WHEN 3 THEN 'days_since_last_attendance' ELSE 'tenure_days' END AS feature,
       (l_quantity - 25) / 1000 AS impact,
       CASE WHEN l_quantity > 25 THEN CASE WHEN l_partkey % 2 = 0 THEN 'sube_riesgo' ELSE 'SUBE_RIESGO' END
            ELSE 'baja_riesgo' END AS effect,
       CAST(l_suppkey AS STRING) AS value
FROM {lineitem}""",
    "raw_text": """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN '1' ELSE '' END AS c_bool,
       CAST(o_custkey AS STRING) AS c_int,
       CAST(o_orderkey * 1000000 AS STRING) AS c_big,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS c_dec,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS c_iso_date,
       lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || CAST(month(o_orderdate) AS STRING) || '/'
         || CAST(year(o_orderdate) AS STRING) AS c_dmy_date,
       CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS c_mixed,
       ' ' || o_orderpriority || ' ' AS c_text
FROM {orders}""",
    "date_texts": """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 10
         WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
         WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
         WHEN 2 THEN lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
         WHEN 3 THEN CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING)
         WHEN 4 THEN CAST(day(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) AS STRING)
         WHEN 5 THEN CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) AS STRING)
         WHEN 6 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T12:34:56+02:00'
         WHEN 7 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || ' 7:05:09'
         WHEN 8 THEN '2025-02-30'
         ELSE 'order ' || CAST(o_orderkey AS STRING) END AS value
FROM {orders}""",
    "sessions": "SELECT DISTINCT l_suppkey AS course_id, l_shipdate AS class_date FROM {lineitem}",
    "enrollments": """
SELECT c_custkey AS student_id, 'C' || CAST(c_nationkey AS STRING) AS course, c_custkey % 3 <> 0 AS is_active
FROM {customer}""",
    "message_log": """
SELECT CAST(c_custkey AS STRING) || '|2000-12-31' AS idempotency_key FROM {customer} WHERE c_custkey % 10 = 0""",
    "message_texts": """
SELECT o_orderkey AS record_id,
       repeat('s', CAST(o_orderkey % 130 AS INT)) || CASE WHEN o_orderkey % 11 = 0 THEN chr(10) ELSE '' END AS subject,
       CASE WHEN o_orderkey % 14 = 0 THEN repeat(' ', 25) ELSE '<p>' || repeat('h', CAST(o_orderkey % 40 AS INT)) || '</p>' END AS html_body,
       ' ' || repeat('t', CAST((o_orderkey * 3) % 2100 AS INT)) || CASE WHEN o_orderkey % 13 = 0 THEN '<b>' ELSE ' ' END AS text_body,
       repeat('c', CAST(o_orderkey % 105 AS INT)) AS cta_label,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE repeat('n', CAST(o_orderkey % 210 AS INT)) END AS compliance_note,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' EN ' WHEN 2 THEN 'e' WHEN 3 THEN 'en-US-x' ELSE 'En' END AS language,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE repeat('k', CAST(o_orderkey % 203 AS INT)) END AS idempotency_key
FROM {orders}""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: base(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql_view(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in BASE})


def core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, n) for n in ("students", "attendance", "payments"))
