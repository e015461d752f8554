import json

import pytest
from pyspark.sql import functions as F

from holdfast.operators import messages as ms
from holdfast.operators import records as rc
from holdfast.plans.scoring import campaign

RECORD = (
    "student_id long, customer_id long, asof_date string, prob_churn double, "
    "reasons array<struct<feature:string,impact:double,effect:string,value:string>>"
)
SAMPLE = [
    ("plan", -0.0174, "baja_riesgo", "Standard"),
    ("payments_90d_usd", 0.0174, "sube_riesgo", "147.0"),
    ("days_since_last_attendance", 0.0164, "sube_riesgo", "1"),
    ("price_usd", -0.0164, "baja_riesgo", "49.0"),
    ("months_since_last_payment", -0.0111, "baja_riesgo", "0.76"),
]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def test_sample_record(spark):
    got = rc.normalize_records(frame(spark, (1001, None, "2025-10-31", 0.5366243621, SAMPLE)), 3).first()
    assert got["customer_id"] == 1001
    assert [tuple(r) for r in got["top_reasons"]] == [
        ("payments_90d_usd", "bajo_pago_reciente", 0.0174, "147.0"),
        ("days_since_last_attendance", "inactividad_reciente", 0.0164, "1"),
    ]


def test_ids_ties_and_defaults(spark):
    tied = [("b", 0.2, "SUBE_RIESGO", "1"), ("a", -0.2, "sube_riesgo", "2"), ("c", None, "sube_riesgo", "3"), ("d", 0.3, None, "4")]
    got = rc.normalize_records(frame(spark, (5, 0, None, None, tied), (0, None, None, 1.0, None))).orderBy("customer_id").collect()
    assert [(r["customer_id"], r["prob_churn"], [e["feature"] for e in r["top_reasons"]]) for r in got] == [
        (0, 1.0, []),
        (5, 0.0, ["b", "a", "c"]),
    ]


def test_rejections(spark):
    rows = frame(spark, (None, None, "d", 0.5, []), (1, 1, "d", float("nan"), []), (2, 2, "d", 1.01, []), (3, 3, "d", -0.1, []), (4, 4, "d", 1.0, []))
    got = {(r["customer_id"], r["rejected"]) for r in rc.rejected_records(rows).collect()}
    assert got == {(None, "missing_id"), (1, "probability_out_of_range"), (2, "probability_out_of_range"), (3, "probability_out_of_range")}
    assert [r["customer_id"] for r in rc.normalize_records(rows).collect()] == [4]


def test_text_probability_and_impact_that_are_no_numbers(spark):
    rows = spark.createDataFrame(
        [(1, "0.5", [("a", "x", "sube_riesgo")]), (2, "y", [("a", "1", "sube_riesgo")]), (3, "0.5", [("a", "x", "baja_riesgo")])],
        "customer_id long, prob_churn string, reasons array<struct<feature:string,impact:string,effect:string>>",
    ).select("*", F.lit("d").alias("asof_date"))
    rows = rows.withColumn("reasons", F.transform("reasons", lambda r: r.withField("value", F.lit("v"))))
    assert {r["customer_id"]: r["rejected"] for r in rc.assess_records(rows).collect()} == {1: "malformed", 2: "malformed", 3: None}


def test_reason_rows_equal_nested_reasons_with_one_hot_key(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 50).alias("record_id"),
        F.col("id").alias("ord"),
        F.concat(F.lit("f"), (F.col("id") % 9).cast("string")).alias("feature"),
        ((F.col("id") * 37 % 101) / 100).alias("impact"),
        F.when(F.col("id") % 3 == 0, "baja_riesgo").otherwise("Sube_Riesgo").alias("effect"),
        F.lit("v").alias("value"),
    )
    table = rc.top_reason_rows(rows, "record_id", ["ord"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "3, Partial" in plan
    nested = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ord", "feature", "impact", "effect", "value"))).alias("reasons"))
    direct = nested.select("record_id", rc.top_reasons(F.col("reasons")).alias("top_reasons"))
    assert sorted(map(str, table.collect())) == sorted(str(r) for r in direct.collect() if r["top_reasons"])


def test_candidates(spark):
    rows = spark.createDataFrame(
        [(1, 0.7, ["r"]), (2, 0.4, ["r"]), (3, 0.39, ["r"]), (4, 0.9, []), (5, None, ["r"]), (6, float("nan"), ["r"]), (7, 0.9, None)],
        "customer_id long, prob_churn double, top_reasons array<string>",
    )
    assert {r["customer_id"]: r["tier"] for r in rc.pick_candidates(rows).collect()} == {1: "high", 2: "medium", 3: "low"}


def contacts(spark):
    return spark.createDataFrame(
        [(1, "Ana <b>", "ana@x.org", "A"), (2, "", " bo@x.org ", None), (3, "Cy", "  ", "A")],
        "student_id long, name string, email string, plan string",
    )


def explained(spark):
    return frame(spark, (1, None, "2025-01-01", 0.8, SAMPLE), (2, None, "", 0.2, SAMPLE), (3, None, "d", 0.8, SAMPLE))


def test_payload_and_messages(spark):
    picked = rc.pick_candidates(rc.normalize_records(explained(spark)))
    payload = ms.message_payload(ms.enrich_contacts(picked, contacts(spark))).orderBy("customer.id").collect()
    assert [(p["customer"]["name"], p["customer"]["email"], p["customer"]["plan"], p["idempotency_key"]) for p in payload] == [
        ("Ana <b>", "ana@x.org", "A", "1|2025-01-01"),
        ("Customer", "bo@x.org", "Monthly", "2"),
    ]
    assert [tuple(p["offer_policy"]) for p in payload] == [(True, "SAVE10", 10), (False, None, 0)]
    got = campaign(explained(spark), contacts(spark)).orderBy("customer_id").collect()
    assert "Ana &lt;b&gt;" in got[0]["html_body"] and "SAVE10" in got[0]["text_body"]
    # A mark-up sign in a name makes the text body invalid, as the rule says.
    assert got[0]["errors"] == ["text_markup"] and got[1]["is_valid"] and "SAVE10" not in got[1]["text_body"]
    assert got[1]["metadata"] == {"campaign_id": "", "tier": "low"}


MESSAGE = "subject string, html_body string, text_body string, cta_label string, compliance_note string, language string, idempotency_key string, metadata map<string,string>"
GOOD = ("Hello", "<p>" + "h" * 20 + "</p>", "t" * 10, "ok", None, "EN", None, None)


@pytest.mark.parametrize(
    "field,value,errors",
    [
        (0, "ab", ["subject_length"]),
        (0, "x" * 121, ["subject_length"]),
        (0, "abc\r", ["subject_newline"]),
        (0, " ab", []),
        (1, "h" * 19, ["html_length"]),
        (1, " " * 20, ["html_blank"]),
        (2, " " * 10, []),
        (2, "t" * 2001, ["text_length"]),
        (2, "a > b, right?", ["text_markup"]),
        (3, "c", ["cta_length"]),
        (4, "n" * 201, ["note_length"]),
        (5, "e", ["language_length"]),
        (5, " e ", []),
        (5, None, []),
        (6, "k" * 201, ["key_length"]),
    ],
)
def test_message_rules(spark, field, value, errors):
    row = list(GOOD)
    row[field] = value
    got = ms.validate_messages(spark.createDataFrame([tuple(row)], MESSAGE)).first()
    assert got["errors"] == errors and got["is_valid"] == (not errors)
    assert got["language"] == (value.strip().lower() if field == 5 and value else "en")


def test_replies(spark):
    base = {"subject": " Hello ", "html_body": GOOD[1], "text_body": GOOD[2], "cta_label": "ok", "metadata": {"a": "b"}, "extra": 1}
    cases = [
        (json.dumps(base), []),
        (json.dumps(base)[:30], ["malformed_json"]),
        ("[1]", ["malformed_json"]),
        (None, ["malformed_json"]),
        (json.dumps({**base, "subject": 5}), ["wrong_type"]),
        (json.dumps({**base, "metadata": {"a": 1}}), ["wrong_type"]),
        (json.dumps({**base, "metadata": None, "compliance_note": None}), []),
        (json.dumps({k: v for k, v in base.items() if k != "cta_label"}), ["cta_length"]),
        (json.dumps({**base, "subject": "a\nbcd"}), ["subject_newline"]),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, reply string")
    got = ms.parse_replies(rows).orderBy("i").collect()
    assert [r["errors"] for r in got] == [e for _, e in cases]
    assert got[0]["subject"] == "Hello" and got[0]["metadata"] == {"a": "b"}


def test_outbox(spark):
    rows = spark.createDataFrame(
        [
            (1, "a@x", "high", 0.9, "k1", True), (2, "a@x", "high", 0.95, "k1", True), (3, "ax", "high", 0.9, "k2", True),
            (4, "b@x", "low", 0.1, "k3", True), (5, "c@x", "medium", 0.5, "k4", False), (6, "d@x", "medium", 0.5, "sent", True),
            (7, "e@x", "medium", 0.6, "k5", True),
        ],
        "customer_id long, email string, tier string, churn_prob double, idempotency_key string, is_valid boolean",
    ).withColumn("subject", F.lit("Hello"))
    log = spark.createDataFrame([("sent",)], "idempotency_key string")
    assert [r["customer_id"] for r in ms.outbox(rows, log, limit=2).collect()] == [2, 7]
    assert {r["customer_id"] for r in ms.outbox(rows, log, limit=None).collect()} == {2, 7, 4}
    assert ms.outbox(rows, None, limit=None, once_per_key=False).count() == 5


def test_reason_text(spark):
    rows = spark.createDataFrame(
        [(1, [("f", "label"), ("g", ""), (None, None)]), (2, []), (3, None)],
        "i int, r array<struct<feature:string,reason_human:string>>",
    )
    assert [r[0] for r in rows.orderBy("i").select(ms.reason_text(F.col("r"))).collect()] == [
        "label, g, reason", ms.NO_REASONS, ms.NO_REASONS,
    ]
