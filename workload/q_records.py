"""Explanation records and retention messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from holdfast.operators import messages, records
from holdfast.session import work_path
from holdfast.sources import files
from workload.oracle import statement
from workload.tables import view

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _records(spark, sf_dir):
    rows = view(spark, sf_dir, "records")
    return records.normalize_record_rows(rows, view(spark, sf_dir, "reasons"), "record_id", ORDER)


def _normalized(spark, sf_dir):
    return records.normalize_records(_records(spark, sf_dir))


def _reasons_text(reasons):
    return F.array_join(
        F.transform(
            reasons,
            lambda r: F.concat_ws(":", r["feature"], r["reason_human"], F.format_string("%.3f", r["impact"]), r["value"]),
        ),
        "|",
    )


def _flat(df, *first):
    return df.select(
        *first,
        "customer_id",
        "prob_churn",
        F.size("top_reasons").cast("bigint").alias("n_reasons"),
        _reasons_text(F.col("top_reasons")).alias("reasons_txt"),
    )


def normalize_records(spark, sf_dir):
    return _flat(_normalized(spark, sf_dir), "record_id")


def rejected_records(spark, sf_dir):
    """One reason each, of which some have an impact that is no number."""
    reason = F.struct(
        F.lit("plan").alias("feature"),
        F.when(F.col("record_id") % 47 == 0, "much").otherwise("0.5").alias("impact"),
        F.lit("sube_riesgo").alias("effect"),
        F.lit("x").alias("value"),
    )
    rows = view(spark, sf_dir, "records").withColumn("reasons", F.array(reason))
    return records.rejected_records(rows).select("record_id", "rejected")


def candidates(spark, sf_dir):
    return _flat(records.pick_candidates(_normalized(spark, sf_dir)), "record_id", "tier")


def _json_arrays(spark, rows):
    """Records written as files of one JSON array each, read back."""

    def array_files(batches):
        """Lines of one JSON array per partition."""
        yield pd.DataFrame({"line": ["["]})
        first = True
        for batch in batches:
            commas = [""] * first + [","] * (len(batch) - first)
            if len(batch):
                yield pd.DataFrame({"line": commas + batch["line"].reset_index(drop=True)})
                first = False
        yield pd.DataFrame({"line": ["]"]})

    path = work_path(spark, "json")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).mapInPandas(array_files, "line string").write.text(path)
    return files.json_records_scan(spark, path)


def json_records_scan(spark, sf_dir):
    rows = _normalized(spark, sf_dir).select("customer_id", "asof_date", "prob_churn", "top_reasons")
    return _flat(_json_arrays(spark, rows).withColumn("customer_id", F.col("customer_id").cast("bigint")))


def campaign_from_json(spark, sf_dir):
    """Records from files, some with text ids, an address or a context of their own, up to checked messages."""
    k = F.col("record_id")
    rows = _normalized(spark, sf_dir).select(
        F.when(k % 13 == 0, F.concat(F.lit("C-"), F.col("customer_id"))).otherwise(F.col("customer_id").cast("string")).alias("customer_id"),
        "asof_date",
        "prob_churn",
        "top_reasons",
        F.when(k % 9 == 0, F.concat(F.lit(" own"), k, F.lit("@example.net"))).alias("email"),
        F.when(k % 3 == 0, "Intensive").alias("product"),
        F.when(k % 4 == 0, "VIP").alias("segment"),
        F.when(k % 2 == 0, k % 90).alias("days_inactive"),
        F.concat(F.lit("r"), k).alias("campaign_id"),
    )
    picked = records.pick_candidates(_json_arrays(spark, rows))
    payload = messages.message_payload(messages.enrich_contacts(picked, view(spark, sf_dir, "contacts")))
    checked = messages.validate_messages(messages.render_messages(payload))
    facts = payload.select(
        "campaign_id", "customer.customer_id", "customer.email", "customer.plan", "customer.segment", "context.days_inactive", "idempotency_key"
    )
    made = checked.select(F.col("metadata")["campaign_id"].alias("campaign_id"), "subject", "is_valid")
    return facts.join(made, "campaign_id")


def json_export(spark, sf_dir):
    path = files.json_export(_normalized(spark, sf_dir), work_path(spark, "export"))
    return _flat(files.json_lines_scan(spark, path).withColumn("customer_id", F.col("customer_id").cast("bigint")))


def _payload(spark, sf_dir):
    picked = records.pick_candidates(_normalized(spark, sf_dir))
    return messages.message_payload(messages.enrich_contacts(picked, view(spark, sf_dir, "contacts")))


def message_payload(spark, sf_dir):
    return _payload(spark, sf_dir).select(
        "record_id",
        F.col("customer.customer_id").alias("customer_id"),
        F.col("customer.name").alias("name"),
        F.col("customer.email").alias("email"),
        F.col("customer.product").alias("product"),
        F.col("customer.plan").alias("plan"),
        F.col("customer.segment").alias("segment"),
        F.col("customer.language").alias("language"),
        F.col("risk.churn_prob").alias("churn_prob"),
        F.col("risk.tier").alias("tier"),
        F.size("risk.top_reasons").cast("bigint").alias("n_reasons"),
        F.col("offer_policy.eligible").alias("eligible"),
        F.coalesce("offer_policy.code", F.lit("")).alias("code"),
        F.col("offer_policy.discount").alias("discount"),
        F.col("cta.label").alias("cta_label"),
        "idempotency_key",
    )


def reason_text(spark, sf_dir):
    return _normalized(spark, sf_dir).select("record_id", messages.reason_text(F.col("top_reasons")).alias("reasons"))


def prompt_text(spark, sf_dir):
    return messages.prompt_text(_payload(spark, sf_dir)).select("record_id", "prompt")


def _rendered(spark, sf_dir):
    return messages.render_messages(_payload(spark, sf_dir))


def render_messages(spark, sf_dir):
    return _rendered(spark, sf_dir).select(
        "record_id",
        "subject",
        "html_body",
        "text_body",
        "cta_label",
        "idempotency_key",
        F.col("metadata")["tier"].alias("metadata_tier"),
        F.col("metadata")["campaign_id"].alias("metadata_campaign"),
    )


def validate_messages(spark, sf_dir):
    rows = view(spark, sf_dir, "message_texts").withColumn("metadata", F.create_map(F.lit("tier"), F.lit("high")))
    return messages.validate_messages(rows).select(
        "record_id", "is_valid", F.array_join("errors", ",").alias("errors"), "language", F.length("text_body").cast("bigint").alias("text_length")
    )


def _replies(spark, sf_dir):
    """Replies as JSON text; some cut short, some with a bad subject, body or field type."""
    k = F.col("record_id")
    m = _rendered(spark, sf_dir)
    subject = F.when(k % 11 == 0, F.concat("subject", F.lit("\n"))).otherwise(F.col("subject"))
    text = F.when(k % 13 == 0, F.concat("text_body", F.lit("<b>"))).otherwise(F.col("text_body"))
    body = F.to_json(
        F.struct(
            subject.alias("subject"), "html_body", text.alias("text_body"), "cta_label", "compliance_note", "language", "idempotency_key", "metadata"
        )
    )
    wrong = F.regexp_replace(body, '"language":"en"', '"language":7')
    reply = F.when(k % 7 == 0, F.left(body, F.lit(40))).when(k % 17 == 0, wrong).otherwise(body)
    return m.select("record_id", reply.alias("reply"))


def parse_replies(spark, sf_dir):
    return messages.parse_replies(_replies(spark, sf_dir)).select(
        "record_id",
        "is_valid",
        F.array_join("errors", ",").alias("errors"),
        F.when(F.col("is_valid"), F.col("subject")).otherwise("").alias("subject"),
        F.when(F.col("is_valid"), F.col("metadata")["tier"]).otherwise("").alias("tier"),
    )


def outbox_batch(spark, sf_dir):
    checked = messages.validate_messages(_rendered(spark, sf_dir))
    queued = messages.outbox(checked, view(spark, sf_dir, "message_log"), limit=200)
    return queued.select("record_id", "customer_id", "email", "tier", "churn_prob", "subject", "idempotency_key", "status")


QUERIES = {
    "normalize_records": normalize_records,
    "rejected_records": rejected_records,
    "candidates": candidates,
    "json_records_scan": json_records_scan,
    "json_export": json_export,
    "campaign_from_json": campaign_from_json,
    "message_payload": message_payload,
    "reason_text": reason_text,
    "prompt_text": prompt_text,
    "render_messages": render_messages,
    "validate_messages": validate_messages,
    "parse_replies": parse_replies,
    "outbox_batch": outbox_batch,
}

_VALID = "customer_id IS NOT NULL AND prob_churn BETWEEN 0 AND 1"
_FLAT = "customer_id, prob_churn, n_reasons, reasons_txt"
_ELIGIBLE = "eligible, CASE WHEN eligible THEN 'SAVE10' ELSE '' END AS code, CASE WHEN eligible THEN 10 ELSE 0 END AS discount"
_NL = "' || chr(10) || '"

ORACLES = {
    "normalize_records": statement(f"SELECT record_id, {_FLAT} FROM normalized WHERE {_VALID}", "normalized"),
    "rejected_records": statement(
        """SELECT record_id, CASE WHEN record_id % 47 = 0 THEN 'malformed' WHEN customer_id IS NULL THEN 'missing_id' ELSE 'probability_out_of_range' END AS rejected FROM (
SELECT record_id, CASE WHEN customer_id IS NOT NULL AND customer_id <> 0 THEN customer_id ELSE student_id END AS customer_id,
coalesce(prob_churn, 0.0) AS prob_churn FROM records) WHERE record_id % 47 = 0 OR customer_id IS NULL OR NOT (prob_churn BETWEEN 0 AND 1)""",
        "records",
    ),
    "candidates": statement(f"SELECT record_id, tier, {_FLAT} FROM picked", "picked"),
    "json_records_scan": statement(f"SELECT {_FLAT} FROM normalized WHERE {_VALID}", "normalized"),
    "json_export": statement(f"SELECT {_FLAT} FROM normalized WHERE {_VALID}", "normalized"),
    "campaign_from_json": statement(
        """SELECT 'r' || record_id AS campaign_id, cid AS customer_id, email, coalesce(plan, 'Monthly') AS plan,
CASE WHEN record_id % 4 = 0 THEN 'VIP' ELSE 'General' END AS segment, CASE WHEN record_id % 2 = 0 THEN record_id % 90 END AS days_inactive,
concat_ws('|', cid, nullif(asof_date, '')) AS idempotency_key,
left('Your place in ' || CASE WHEN record_id % 3 = 0 THEN 'Intensive' ELSE 'Your plan' END || ', ' || coalesce(nullif(name, ''), 'Customer'), 120) AS subject,
true AS is_valid FROM (SELECT p.*, c.name, c.plan, trim(CASE WHEN record_id % 9 = 0 THEN 'own' || record_id || '@example.net' ELSE c.email END) AS email
FROM (SELECT *, CASE WHEN record_id % 13 = 0 THEN 'C-' ELSE '' END || customer_id AS cid FROM picked) p
LEFT JOIN contacts c ON CAST(c.student_id AS VARCHAR) = cid) WHERE email <> ''""",
        "picked",
        "contacts",
    ),
    "message_payload": statement(
        f"""SELECT record_id, customer_id, name, email, 'Your plan' AS product, plan, 'General' AS segment, 'en' AS language,
prob_churn AS churn_prob, tier, n_reasons, {_ELIGIBLE}, 'Reply YES to continue' AS cta_label, idempotency_key FROM payload""",
        "payload",
    ),
    "reason_text": statement(
        f"""SELECT record_id, CASE WHEN n_reasons = 0 THEN 'no specific reasons available' ELSE labels_txt END AS reasons
FROM normalized WHERE {_VALID}""",
        "normalized",
    ),
    "prompt_text": statement(
        f"""SELECT record_id, concat_ws(chr(10), 'cta.label = Reply YES to continue', 'customer.id = ' || customer_id, 'customer.name = ' || name,
'customer.plan = ' || plan, 'customer.product = Your plan', 'customer.segment = General', CASE WHEN eligible THEN 'offer_policy.code = SAVE10' END,
'offer_policy.discount = ' || CASE WHEN eligible THEN 10 ELSE 0 END, 'risk.tier = ' || tier, 'risk.churn_prob = ' || printf('%.4f', prob_churn),
'risk.top_reasons = ' || labels_txt, '', '{messages.BRIEF}') AS prompt FROM payload""",
        "payload",
    ),
    "render_messages": statement(
        """SELECT record_id, subject, html_body, text_body, 'Reply YES to continue' AS cta_label, idempotency_key,
tier AS metadata_tier, '' AS metadata_campaign FROM rendered""",
        "rendered",
    ),
    "validate_messages": statement(
        r"""SELECT record_id, errors = '' AS is_valid, errors, lower(trim(language)) AS language, length(trim(text_body)) AS text_length FROM (
SELECT *, concat_ws(',',
  CASE WHEN NOT (length(subject) BETWEEN 3 AND 120) THEN 'subject_length' END,
  CASE WHEN contains(subject, chr(10)) THEN 'subject_newline' END,
  CASE WHEN length(html_body) < 20 THEN 'html_length' END,
  CASE WHEN trim(html_body) = '' THEN 'html_blank' END,
  CASE WHEN NOT (length(text_body) BETWEEN 10 AND 2000) THEN 'text_length' END,
  CASE WHEN contains(text_body, '<') THEN 'text_markup' END,
  CASE WHEN NOT (length(cta_label) BETWEEN 2 AND 100) THEN 'cta_length' END,
  CASE WHEN length(compliance_note) > 200 THEN 'note_length' END,
  CASE WHEN NOT (length(language) BETWEEN 2 AND 5) THEN 'language_length' END,
  CASE WHEN length(idempotency_key) > 200 THEN 'key_length' END) AS errors
FROM (SELECT * REPLACE (coalesce(language, 'en') AS language) FROM message_texts))""",
        "message_texts",
    ),
    "parse_replies": statement(
        """SELECT record_id, errors = '' AS is_valid, errors, CASE WHEN errors = '' THEN subject ELSE '' END AS subject,
CASE WHEN errors = '' THEN tier ELSE '' END AS tier FROM (
SELECT *, CASE WHEN record_id % 7 = 0 THEN 'malformed_json' WHEN record_id % 17 = 0 THEN 'wrong_type'
ELSE concat_ws(',', CASE WHEN record_id % 11 = 0 THEN 'subject_newline' END, CASE WHEN record_id % 13 = 0 THEN 'text_markup' END) END AS errors
FROM rendered)""",
        "rendered",
    ),
    "outbox_batch": statement(
        """SELECT record_id, customer_id, email, tier, prob_churn AS churn_prob, subject, idempotency_key, 'queued' AS status FROM (
SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY prob_churn DESC, record_id) AS place FROM rendered
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM message_log) AND contains(email, '@'))
WHERE place = 1 ORDER BY prob_churn DESC, record_id LIMIT 200""",
        "rendered",
        "message_log",
    ),
}
