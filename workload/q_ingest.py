"""Sources, sinks and column types."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import dates
from holdfast.operators import typing as types
from holdfast.operators.training import training_columns
from holdfast.plans.ingest import ingest_file, ingest_files
from holdfast.session import work_path
from holdfast.sources import files, tables
from workload.model import model_columns, training_table
from workload.oracle import statement
from workload.tables import CUTOFF, base, sql_view, view

TEXT_COLUMNS = ["c_bool", "c_int", "c_big", "c_dec", "c_iso_date", "c_dmy_date", "c_mixed", "c_text"]
COERCED = {
    "c_bool": "TINYINT(1)",
    "c_int": "INT",
    "c_big": "BIGINT",
    "c_dec": "DECIMAL(18,6)",
    "c_iso_date": "DATETIME",
    "c_dmy_date": "DATE",
    "c_mixed": "INT",
    "c_text": "VARCHAR(255)",
}
# Columns and types of the given tables.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def csv_scan(spark, sf_dir):
    """Written and read again, with line breaks and quotes inside values; empty texts are NULLs."""
    path = work_path(spark, "csv")
    k = F.col("row_id")
    note = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.lit('two\n"lines" '), k.cast("string"))).when(k % 5 == 0, "").otherwise("x, y")
    files.csv_write(view(spark, sf_dir, "raw_text").withColumn("c_note", note), path)
    rows = files.csv_scan(spark, path)
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), *TEXT_COLUMNS, "c_note")


def param_scan(spark, sf_dir):
    text = f"""
SELECT student_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM {{payments}}
WHERE payment_date <= CAST(:cutoff AS DATE) AND amount >= :least GROUP BY student_id"""
    return tables.query(
        spark, text, {"cutoff": CUTOFF, "least": 1000}, payments=view(spark, sf_dir, "payments")
    )


def append_sink(spark, sf_dir):
    path, rows = work_path(spark, "table"), view(spark, sf_dir, "payments")
    first = tables.write_table(rows, path)
    second = tables.write_table(rows, path)
    twice = tables.read_table(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("payment_id").alias("ids"))
    n, ids = twice.first()
    tables.write_table(rows, path, overwrite=True)
    return tables.read_table(spark, path).agg(
        F.lit(first + second).cast("bigint").alias("written"),
        F.lit(n).cast("bigint").alias("after_append"),
        F.lit(ids).cast("bigint").alias("ids"),
        F.count(F.lit(1)).alias("after_overwrite"),
    )


def ingest_report(spark, sf_dir):
    folder = work_path(spark, "ingest")
    for name in ("students", "payments", "attendance"):
        files.csv_write(view(spark, sf_dir, name), f"{folder}/csv/{name}")
    wanted = ["students", "teachers", "payments", "attendance"]
    return ingest_files(spark, [(f"{folder}/csv/{n}", n) for n in wanted], f"{folder}/tables")


def ingest_twice(spark, sf_dir):
    """A second file for a table: with a text in a number column, and a column more."""
    folder, rows = work_path(spark, "ingest"), view(spark, sf_dir, "payments")
    first = rows.select("payment_id", F.col("student_id").cast("string").alias("student"), "amount", "status")
    odd = F.when(F.col("payment_id") % 10 == 0, F.concat(F.lit("s"), F.col("student_id"))).otherwise(F.col("student_id").cast("string"))
    second = rows.select("payment_id", odd.alias("student"), "amount", F.lit("late").alias("note"))
    for name, part in (("one", first), ("two", second)):
        files.csv_write(part, f"{folder}/{name}")
        ingest_file(spark, f"{folder}/{name}", f"{folder}/table")
    kept = tables.read_table(spark, f"{folder}/table")
    last = kept.agg(F.max(types.ROW_ID), F.count_distinct(types.ROW_ID)).first()
    return kept.select(
        F.col("payment_id").cast("bigint").alias("payment_id"),
        F.col("student").cast("bigint").alias("student"),
        F.col("amount").cast("double").alias("amount"),
        "status",
        "note",
        F.col(types.RESCUED)["student"].alias("rescued"),
        F.lit(last[0]).cast("bigint").alias("last_id"),
        F.lit(last[1]).cast("bigint").alias("ids"),
    )


def table_columns(spark, sf_dir):
    return types.table_columns({t: base(spark, sf_dir, t) for t in TABLES}, filled=True)


def infer_types(spark, sf_dir):
    return types.infer_types(view(spark, sf_dir, "raw_text"), TEXT_COLUMNS)


def value_predicates(spark, sf_dir):
    rows = view(spark, sf_dir, "raw_text")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.nullif(F.trim(c), F.lit("")).alias("value")) for c in TEXT_COLUMNS])
    long = rows.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    tests = types.value_predicates(F.col("value"))
    return long.groupBy("column_name").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def coerce_rows(spark, sf_dir):
    typed = types.coerce_rows(view(spark, sf_dir, "raw_text"), COERCED)
    return typed.select(
        "row_id",
        *[F.col(c).cast("string").alias(c) for c in COERCED],
        F.coalesce(F.array_join(F.map_values(types.RESCUED), ","), F.lit("")).alias("rescued"),
    )


def parse_dates(spark, sf_dir):
    v = F.col("value")
    return view(spark, sf_dir, "date_texts").select(
        "row_id",
        dates.parse_date(v).cast("string").alias("parsed_date"),
        dates.parse_datetime(v).cast("string").alias("parsed_datetime"),
    )


def schema_evolve(spark, sf_dir):
    old = view(spark, sf_dir, "payments").select("payment_id", "student_id", "status")
    new = view(spark, sf_dir, "payments").select("payment_id", "student_id", F.col("amount").cast("double").alias("amount"))
    return types.evolve(old, new)


def row_ids(spark, sf_dir):
    i = F.col("_row_id")
    """Numbers of two scans, the second from where the first one ends."""
    lines = base(spark, sf_dir, "lineitem").select("l_orderkey")
    orders = base(spark, sf_dir, "orders").select("o_orderkey")
    first = types.scan_row_ids(orders)
    numbered = first.select("_row_id").unionByName(types.scan_row_ids(lines, start=orders.count()).select("_row_id"))
    return numbered.agg(
        F.count(i).alias("n"), F.count_distinct(i).alias("ids"), F.min(i).alias("first"), F.max(i).alias("last")
    )


def label_count(spark, sf_dir):
    return types.label_count(training_table(spark, sf_dir).withColumn("abandono", F.col("abandono").cast("string")))


def training_column_roles(spark, sf_dir):
    return training_columns(model_columns(training_table(spark, sf_dir)))


QUERIES = {
    "csv_scan": csv_scan,
    "param_scan": param_scan,
    "append_sink": append_sink,
    "ingest_report": ingest_report,
    "ingest_twice": ingest_twice,
    "table_columns": table_columns,
    "infer_types": infer_types,
    "value_predicates": value_predicates,
    "coerce_rows": coerce_rows,
    "parse_dates": parse_dates,
    "schema_evolve": schema_evolve,
    "row_ids": row_ids,
    "label_count": label_count,
    "training_columns": training_column_roles,
}

# Patterns of numbers, boolean words and date layouts that the library accepts too.
_INT = r"regexp_full_match(v, '[+-]?[0-9]+')"
_NUM = r"regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
_BOOL = "lower(v) IN ('true', 'false', '0', '1', 'yes', 'no', 'y', 'n')"
_DATE = "try_strptime(v, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y'])"
_ISO = r"(CASE WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2})?)?') THEN TRY_CAST(left(replace(v, 'T', ' '), 19) AS TIMESTAMP) END)"
_STAMP = f"coalesce({_ISO}, try_strptime(v, ['%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%m/%d/%Y %H:%M:%S']))"
_LONG = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, nullif(trim({c}), '') AS v FROM raw_text" for i, c in enumerate(TEXT_COLUMNS)
)

ORACLES = {
    "csv_scan": f"""SELECT * REPLACE (nullif(c_bool, '') AS c_bool), CASE WHEN row_id % 11 = 0 THEN NULL
WHEN row_id % 7 = 0 THEN 'two' || chr(10) || '"lines" ' || row_id WHEN row_id % 5 = 0 THEN NULL ELSE 'x, y' END AS c_note FROM ({sql_view("raw_text")})""",
    "ingest_twice": statement(
        """SELECT payment_id, student_id AS student, CAST(amount AS DOUBLE) AS amount, status, NULL AS note, NULL AS rescued,
2 * (SELECT count(*) FROM payments) AS last_id, 2 * (SELECT count(*) FROM payments) AS ids FROM payments
UNION ALL SELECT payment_id, CASE WHEN payment_id % 10 <> 0 THEN student_id END, CAST(amount AS DOUBLE), NULL, 'late',
CASE WHEN payment_id % 10 = 0 THEN 's' || student_id END, 2 * (SELECT count(*) FROM payments), 2 * (SELECT count(*) FROM payments) FROM payments""",
        "payments",
    ),
    "param_scan": statement(
        f"""SELECT student_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM payments
WHERE payment_date <= DATE '{CUTOFF}' AND amount >= 1000 GROUP BY student_id""",
        "payments",
    ),
    "append_sink": """SELECT 2 * count(*) AS written, 2 * count(*) AS after_append,
count(DISTINCT o_orderkey) AS ids, count(*) AS after_overwrite FROM orders""",
    "ingest_report": """SELECT 'students' AS table_name, 'loaded' AS status, count(*) AS row_count FROM customer
UNION ALL SELECT 'teachers', 'missing', 0
UNION ALL SELECT 'payments', 'loaded', count(*) FROM orders
UNION ALL SELECT 'attendance', 'loaded', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "table_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i + 1} AS position, '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS filled FROM {t}"
        for t, listed in TABLES.items()
        for i, (c, kind) in enumerate(x.split() for x in listed.split(", "))
    ),
    "infer_types": statement(
        f"""SELECT position, column_name, CASE WHEN count(v) = 0 THEN 'VARCHAR(255)'
WHEN bool_and({_BOOL}) THEN 'TINYINT(1)'
WHEN bool_and({_INT}) THEN CASE WHEN max(abs(TRY_CAST(v AS HUGEINT))) <= 2147483647 THEN 'INT' ELSE 'BIGINT' END
WHEN bool_and({_NUM}) THEN 'DECIMAL(18,6)'
WHEN bool_and({_STAMP} IS NOT NULL) THEN 'DATETIME'
WHEN bool_and({_DATE} IS NOT NULL) THEN 'DATE'
WHEN max(length(v)) > 1000 THEN 'LONGTEXT' WHEN max(length(v)) > 255 THEN 'TEXT' ELSE 'VARCHAR(255)' END AS type_label
FROM ({_LONG}) GROUP BY position, column_name""",
        "raw_text",
    ),
    "value_predicates": statement(
        f"""SELECT column_name, count(*) FILTER (WHERE {_BOOL}) AS is_bool, count(*) FILTER (WHERE {_INT}) AS is_int,
count(*) FILTER (WHERE {_NUM} AND NOT {_INT}) AS is_decimal,
count(*) FILTER (WHERE {_STAMP} IS NOT NULL) AS is_datetime, count(*) FILTER (WHERE {_DATE} IS NOT NULL) AS is_date
FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY column_name""",
        "raw_text",
    ),
    "coerce_rows": statement(
        f"""SELECT row_id, CASE lower(c_bool) WHEN 'yes' THEN '1' WHEN '1' THEN '1' WHEN 'no' THEN '0' END AS c_bool,
c_int, c_big, CAST(CAST(c_dec AS DECIMAL(18,6)) AS VARCHAR) AS c_dec, c_iso_date || ' 00:00:00' AS c_iso_date,
CAST(CAST(strptime(c_dmy_date, '%d/%m/%Y') AS DATE) AS VARCHAR) AS c_dmy_date,
nullif(c_mixed, 'n/a') AS c_mixed, trim(c_text) AS c_text, CASE WHEN c_mixed = 'n/a' THEN 'n/a' ELSE '' END AS rescued
FROM raw_text""",
        "raw_text",
    ),
    "parse_dates": statement(
        f"""SELECT row_id, CAST(CAST({_DATE} AS DATE) AS VARCHAR) AS parsed_date,
strftime({_STAMP}, '%Y-%m-%d %H:%M:%S') AS parsed_datetime FROM (SELECT row_id, value AS v FROM date_texts)""",
        "date_texts",
    ),
    "schema_evolve": statement(
        """SELECT payment_id, student_id, status, CAST(NULL AS DOUBLE) AS amount FROM payments
UNION ALL SELECT payment_id, student_id, NULL, CAST(amount AS DOUBLE) FROM payments""",
        "payments",
    ),
    "row_ids": "SELECT count(*) AS n, count(*) AS ids, 1 AS first, count(*) AS last FROM (SELECT 1 FROM lineitem UNION ALL SELECT 1 FROM orders)",
    "label_count": statement("SELECT count(*) AS positives FROM training WHERE abandono = 1", "training"),
    "training_columns": statement(
        """SELECT column_name, role, CASE column_name WHEN 'email' THEN (SELECT count(email) FROM students)
WHEN 'signup_date' THEN (SELECT count(signup_date) FROM students) ELSE (SELECT count(*) FROM students) END AS filled
FROM (VALUES ('customer_id', 'dropped'), ('plan', 'categorical'),
('price_usd', 'numeric'), ('tenure_days', 'numeric'), ('days_since_last_attendance', 'numeric'),
('total_classes_30d', 'numeric'), ('total_classes_60d', 'numeric'), ('total_classes_90d', 'numeric'),
('months_since_last_payment', 'numeric'), ('payments_90d_usd', 'numeric'), ('n_payments_90d', 'numeric'),
('email', 'dropped'), ('signup_date', 'dropped'), ('is_active', 'dropped'), ('update_count', 'dropped'),
('abandono', 'target')) t(column_name, role)""",
        "students",
    ),
}
