"""Contributions, explanations and importance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.functions.text import initials
from holdfast.operators import explain, forest, messages, records, reports, training
from holdfast.plans import scoring
from holdfast.session import materialize
from holdfast.sources import models
from workload.model import aligned_rows, bundle, feature_rows, loaded, model_columns, training_table
from workload.oracle import NUMBERS, statement
from workload.pinned import CATEGORIES, CONTRACT, NODES, pinned_forest
from workload.tables import ASOF, view


def _encoded(spark, sf_dir):
    rows = scoring.aligned(feature_rows(spark, sf_dir), CONTRACT)
    return explain.encode(rows, CONTRACT["numeric_cols"], CONTRACT["categories"])


def _contributions(spark, sf_dir):
    return forest.shap_values(_encoded(spark, sf_dir), pinned_forest(spark))


def explained(spark, sf_dir, top_k=5):
    pinned = pinned_forest(spark)
    return scoring.explain_features(
        feature_rows(spark, sf_dir), pinned, CONTRACT, top_k, score=lambda x: forest.score_rows(x, NODES)
    )


NAMES = explain.encoded_names(CONTRACT["numeric_cols"], CONTRACT["categories"])
ORIGINS = explain.encoded_origins(CONTRACT["numeric_cols"], CONTRACT["categories"])


def feature_map(spark, sf_dir):
    """Of an encoder fitted on the training columns."""
    table = model_columns(training_table(spark, sf_dir))
    rows = training.prepare(table, NUMBERS, ["plan"])
    model = training.encoder(NUMBERS, ["plan"]).fit(rows)
    return explain.feature_map(spark, NUMBERS, training.categories_of(model, ["plan"]))


def shap_values(spark, sf_dir):
    long = _contributions(spark, sf_dir).select("student_id", F.posexplode_outer("phi").alias("position", "phi"))
    name = explain.at_position(NAMES, F.col("position")).alias("encoded_name")
    return long.select("student_id", name, F.round("phi", 9).alias("phi"))


def shap_additivity(spark, sf_dir):
    """The trained forest: base plus contributions, and its own scores, against Spark's probability for every student."""
    path = bundle(spark, sf_dir)
    model, contract = loaded(spark, path)
    ensemble = scoring.forest_of_bundle(spark, path)
    scored = training.probability(aligned_rows(spark, sf_dir, contract), model, keep_vector=True)
    own = forest.with_score(forest.shap_values(scored, ensemble), ensemble, out="own_score")
    own = forest.score(own, ensemble, out="walked")
    return own.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(F.col("own_score") - F.col("churn_risk")) > 1e-9).alias("sum_differs"),
        F.count_if(F.abs(F.col("walked") - F.col("churn_risk")) > 1e-9).alias("score_differs"),
    )


def explain_students(spark, sf_dir):
    rows = explained(spark, sf_dir).select("student_id", "churn_risk", F.posexplode_outer("reasons").alias("place", "r"))
    return rows.select(
        "student_id",
        F.round("churn_risk", 9).alias("prob_churn"),
        (F.col("place") + 1).cast("bigint").alias("place"),
        "r.feature",
        F.round("r.impact", 9).alias("impact"),
        "r.effect",
        "r.value",
    )


def global_importance(spark, sf_dir):
    ranked = explain.global_importance(_contributions(spark, sf_dir), ORIGINS)
    return ranked.select(
        "orig_feature",
        F.round("global_sum_abs_shap", 7).alias("global_sum_abs_shap"),
        F.round("global_mean_abs_shap", 9).alias("global_mean_abs_shap"),
        F.round("global_net", 9).alias("global_net"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def background_sample(spark, sf_dir):
    """300 students by a hash that both engines can compute, in encoded form."""
    order = (F.col("student_id") * 7919 + 42) % 10007
    sample = explain.background_sample(_encoded(spark, sf_dir), 300, order=order)
    return sample.select("student_id", F.col("x")[1].alias("tenure_days"), F.col("x")[10].alias("plan_building"))


def top_drivers(spark, sf_dir):
    return reports.top_drivers(explained(spark, sf_dir)).withColumn("share", F.round("share", 9))


def prioritized_list(spark, sf_dir):
    last_paid = reports.last_payments(view(spark, sf_dir, "payments"), ASOF)
    listed = reports.prioritized_list(explained(spark, sf_dir), view(spark, sf_dir, "contacts"), last_paid)
    rounded = {"churn_risk": F.round("churn_risk", 9), "months_since_last_payment": F.round("months_since_last_payment", 6)}
    return listed.withColumns({**rounded, "last_payment": F.col("last_payment").cast("string")})


def student_filter(spark, sf_dir):
    """Students of two tiers and all courses whose name or e-mail contains a text."""
    scored = forest.score_rows(_encoded(spark, sf_dir), NODES).select("student_id", "churn_risk")
    rows = scored.join(view(spark, sf_dir, "contacts"), "student_id").withColumn(
        "tier", F.when(F.col("churn_risk") >= 0.7, "high").when(F.col("churn_risk") >= 0.4, "medium").otherwise("low")
    )
    found = reports.filter_students(rows, tier="high", text="R#0000001").unionByName(
        reports.filter_students(rows, course="C3", tier="medium", text=".COM")
    )
    return found.select("student_id", "name", "course", "tier")


def explained_records(spark, sf_dir):
    """Explanations through the normaliser: risk-raising reasons only, at most three, labelled."""
    raw = scoring.explanation_records(explained(spark, sf_dir), ASOF)
    rows = records.normalize_records(raw).select("customer_id", "asof_date", "prob_churn", F.posexplode_outer("top_reasons").alias("place", "r"))
    return rows.select(
        "customer_id",
        "asof_date",
        F.round("prob_churn", 9).alias("prob_churn"),
        F.coalesce(F.col("place") + 1, F.lit(0)).cast("bigint").alias("place"),
        F.coalesce("r.feature", F.lit("")).alias("feature"),
        F.coalesce("r.reason_human", F.lit("")).alias("reason_human"),
    )


def campaign_scored(spark, sf_dir):
    """From the raw tables to checked messages in one go: features, scores, explanations, records, messages."""
    raw = scoring.explanation_records(explained(spark, sf_dir), ASOF)
    made = scoring.campaign(raw, view(spark, sf_dir, "contacts"))
    return made.select(
        "customer_id", "email", "tier", F.round("churn_prob", 9).alias("churn_prob"), "subject", "text_body", "idempotency_key", "is_valid"
    )


def campaign_trained(spark, sf_dir):
    """The same from a trained forest: what must hold for any model."""
    path = bundle(spark, sf_dir)
    ensemble, contract = scoring.forest_of_bundle(spark, path), models.load_contract(spark, path)
    found = materialize(scoring.explain_features(feature_rows(spark, sf_dir), ensemble, contract))
    contacts = view(spark, sf_dir, "contacts")
    raw = scoring.explanation_records(found, ASOF)
    picked = messages.enrich_contacts(records.pick_candidates(records.normalize_records(raw)), contacts)
    wanted = messages.message_payload(picked).select("idempotency_key")
    made = scoring.campaign(raw, contacts).groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_valid").alias("valid"))
    checked = wanted.join(made, "idempotency_key", "full_outer").agg(
        F.count_if(F.col("n").isNull() | (F.col("n") != 1)).alias("not_once"), F.count_if(~F.col("valid")).alias("broken")
    )
    impact = F.transform("reasons", lambda r: F.abs(r["impact"]))
    ordered = F.array_size("reasons").between(1, 5) & F.forall("reasons", lambda r: r["effect"].isin(explain.RAISES, explain.LOWERS))
    # A category's impact is the net of its columns, so only numbers have to be in order.
    plain = F.transform(F.filter("reasons", lambda r: r["feature"] != "plan"), lambda r: F.abs(r["impact"]))
    in_order = F.forall(F.sequence(F.lit(1), F.array_size(plain)), lambda i: (i == 1) | (F.get(plain, i - 2) >= F.get(plain, i - 1)))
    return found.agg(
        F.count(F.lit(1)).alias("students"),
        F.count_if(F.col("churn_risk").between(0.0, 1.0)).alias("in_range"),
        F.count_if(ordered & (F.array_size(impact) > 0)).alias("with_reasons"),
        F.count_if(F.coalesce(in_order, F.lit(True))).alias("in_order"),
    ).join(checked)


def importance_trained(spark, sf_dir):
    """Global importance by a trained forest over all students: the features it ranks, and what must hold for any model."""
    path = bundle(spark, sf_dir)
    ensemble, contract = scoring.forest_of_bundle(spark, path), models.load_contract(spark, path)
    x = explain.encode(aligned_rows(spark, sf_dir, contract), contract["numeric_cols"], contract["categories"])
    origins = explain.encoded_origins(contract["numeric_cols"], contract["categories"])
    ranked = explain.global_importance(forest.shap_values(x, ensemble), origins)
    before = F.lag("global_sum_abs_shap").over(Window.orderBy("rank"))  # one row a feature
    return ranked.select(
        "orig_feature",
        F.coalesce(before >= F.col("global_sum_abs_shap"), F.lit(True)).alias("in_order"),
        (F.abs("global_net") <= F.col("global_mean_abs_shap") + 1e-12).alias("net_within_mean"),
        F.col("rank").between(1, len(set(origins))).alias("ranked"),
    )


QUERIES = {
    "importance_trained": importance_trained,
    "campaign_scored": campaign_scored,
    "campaign_trained": campaign_trained,
    "feature_map": feature_map,
    "shap_values": shap_values,
    "shap_additivity": shap_additivity,
    "explain_students": explain_students,
    "global_importance": global_importance,
    "background_sample": background_sample,
    "top_drivers": top_drivers,
    "prioritized_list": prioritized_list,
    "student_filter": student_filter,
    "explained_records": explained_records,
}

_N = len(NUMBERS)

ORACLES = {
    "importance_trained": "SELECT unnest(["
    + ", ".join(f"'{c}'" for c in [*NUMBERS, "plan"])
    + "]) AS orig_feature, true AS in_order, true AS net_within_mean, true AS ranked",
    "campaign_scored": statement(
        """SELECT customer_id, email, tier, round(prob_churn, 9) AS churn_prob, subject, text_body, idempotency_key, true AS is_valid
FROM own_rendered""",
        "own_rendered",
    ),
    "campaign_trained": "SELECT count(*) AS students, count(*) AS in_range, count(*) AS with_reasons, count(*) AS in_order, 0 AS not_once, 0 AS broken FROM customer",
    "feature_map": statement(
        f"""SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', '{c}')" for i, c in enumerate(NUMBERS))}) t(position, encoded_name, orig_feature)
UNION ALL SELECT CAST({_N} + row_number() OVER (ORDER BY plan) - 1 AS INT), 'plan=' || plan, 'plan'
FROM (SELECT DISTINCT coalesce(plan, 'None') AS plan FROM contacts)""",
        "contacts",
    ),
    "shap_values": statement(
        """SELECT f.student_id, o.encoded_name, round(coalesce(p.phi, 0.0), 9) AS phi FROM features f CROSS JOIN origins o
LEFT JOIN phi p ON p.student_id = f.student_id AND p.pos = o.pos""",
        "features",
        "origins",
        "phi",
    ),
    "shap_additivity": "SELECT count(*) AS n, 0 AS sum_differs, 0 AS score_differs FROM customer",
    "explain_students": statement(
        """SELECT student_id, round(churn_risk, 9) AS prob_churn, place, feature, round(impact, 9) AS impact, effect, value
FROM explained WHERE place <= 5""",
        "explained",
    ),
    "global_importance": statement(
        """SELECT feature AS orig_feature, round(sum(s), 7) AS global_sum_abs_shap, round(avg(m), 9) AS global_mean_abs_shap,
round(avg(net), 9) AS global_net, row_number() OVER (ORDER BY round(sum(s), 7) DESC, feature) AS rank
FROM (SELECT o.feature, o.pos, coalesce(sum(abs(phi)), 0) AS s, coalesce(sum(abs(phi)), 0) / (SELECT count(*) FROM features) AS m,
      coalesce(sum(phi), 0) / (SELECT count(*) FROM features) AS net FROM origins o LEFT JOIN phi p ON p.pos = o.pos GROUP BY o.feature, o.pos)
GROUP BY feature""",
        "features",
        "origins",
        "phi",
    ),
    "background_sample": statement(
        """SELECT student_id, CAST(tenure_days AS DOUBLE) AS tenure_days, CASE WHEN plan = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0 END AS plan_building
FROM features ORDER BY (student_id * 7919 + 42) % 10007, student_id LIMIT 300""",
        "features",
    ),
    "top_drivers": statement(
        """SELECT feature AS driver, count(*) AS students, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share
FROM explained WHERE place = 1 GROUP BY feature""",
        "explained",
    ),
    "prioritized_list": statement(
        """SELECT e.student_id, round(e.churn_risk, 9) AS churn_risk, e.feature AS reason, r.reasons, s.price_usd,
round(s.months_since_last_payment, 6) AS months_since_last_payment,
CASE WHEN e.churn_risk >= 0.7 THEN 'high' WHEN e.churn_risk >= 0.4 THEN 'medium' ELSE 'low' END AS tier,
CASE WHEN e.churn_risk >= 0.7 THEN 'At risk' WHEN e.churn_risk >= 0.4 THEN 'Overdue' ELSE 'OK' END AS status,
CAST(CAST(i.latest AS DATE) AS VARCHAR) AS last_payment,
c.name, 'C' AS initials, c.email FROM explained e JOIN scored s USING (student_id) JOIN contacts c USING (student_id)
JOIN (SELECT student_id, string_agg(feature, ', ' ORDER BY place) AS reasons FROM explained WHERE place <= 5 GROUP BY student_id) r USING (student_id)
LEFT JOIN income i USING (student_id) WHERE e.place = 1""",
        "explained",
        "scored",
        "contacts",
        "income",
    ),
    "student_filter": statement(
        """SELECT * FROM (SELECT student_id, name, course,
CASE WHEN churn_risk >= 0.7 THEN 'high' WHEN churn_risk >= 0.4 THEN 'medium' ELSE 'low' END AS tier, email
FROM scored JOIN contacts USING (student_id))
WHERE (tier = 'high' AND (name ILIKE '%r#0000001%' OR email ILIKE '%r#0000001%'))
   OR (course = 'C3' AND tier = 'medium' AND (name ILIKE '%.com%' OR email ILIKE '%.com%'))""".replace("SELECT * FROM (", "SELECT student_id, name, course, tier FROM (", 1),
        "scored",
        "contacts",
    ),
    "explained_records": statement(
        f"""SELECT s.student_id AS customer_id, '{ASOF}' AS asof_date, round(s.churn_risk, 9) AS prob_churn,
coalesce(t.place, 0) AS place, coalesce(t.feature, '') AS feature, coalesce(t.label, '') AS reason_human
FROM scored s LEFT JOIN (
  SELECT e.student_id, e.feature, coalesce(l.label, e.feature) AS label,
         row_number() OVER (PARTITION BY e.student_id ORDER BY abs(e.impact) DESC, e.place) AS place
  FROM explained e LEFT JOIN labels_of l ON l.feature = e.feature WHERE e.place <= 5 AND e.effect = 'sube_riesgo'
) t ON t.student_id = s.student_id AND t.place <= 3""",
        "scored",
        "explained",
        "labels_of",
    ),
}
