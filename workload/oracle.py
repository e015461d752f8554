"""SQL statements of the shared steps: features, fixed forest, contributions, records, messages."""

from __future__ import annotations

from workload.pinned import CATEGORIES, PATHS, SQL_TREES
from workload.tables import ASOF, CUTOFF, VIEWS, sql_view

# The paid statuses.
PAID = "coalesce(lower(status), 'paid') IN ('completed', 'paid', 'success', 'approved', 'ok')"
NUMBERS = [
    "price_usd", "tenure_days", "days_since_last_attendance", "total_classes_30d", "total_classes_60d",
    "total_classes_90d", "months_since_last_payment", "payments_90d_usd", "n_payments_90d",
]


def days(since: str, cutoff: str = CUTOFF) -> str:
    return f"CAST(floor((epoch(TIMESTAMP '{cutoff}') - epoch({since})) / 86400) AS BIGINT)"


def _within(n: int) -> str:
    """The n days that end with the cutoff day."""
    return f"BETWEEN DATE '{CUTOFF}' - INTERVAL {n - 1} DAY AND DATE '{CUTOFF}'"


_ENCODED = ", ".join([f"CAST({c} AS DOUBLE)" for c in NUMBERS] + [f"CASE WHEN plan = '{c}' THEN 1.0 ELSE 0.0 END" for c in CATEGORIES])
# Reason labels.
_LABELS = """('months_since_last_payment', 'atraso_pago'), ('payments_90d_usd', 'bajo_pago_reciente'),
('plan', 'plan_inadecuado'), ('price_usd', 'precio_alto'), ('total_classes_90d', 'bajo_uso_3m'),
('days_since_last_attendance', 'inactividad_reciente'), ('total_classes_60d', 'bajo_uso_2m'),
('total_classes_30d', 'bajo_uso_1m')"""

STEPS = {
    "classes": ["attendance"],
    "income": ["payments"],
    "features": ["students", "classes", "income"],
    "scored": ["features"],
    "encoded": ["features"],
    "phi": ["encoded"],
    "origins": [],
    "folded": ["phi", "origins"],
    "explained": ["folded", "scored"],
    "training": ["features", "payments"],
    "labels_of": [],
    "raisers": ["reasons", "labels_of"],
    "normalized": ["records", "raisers"],
    "picked": ["normalized"],
    "payload": ["picked", "contacts"],
    "rendered": ["payload"],
}

TEXTS = {
    "classes": f"""
SELECT student_id, max(class_date) AS latest, {", ".join(f"sum(coalesce(present, 1)) FILTER (WHERE class_date {_within(n)}) AS days_{n}" for n in (30, 60, 90))}
FROM attendance WHERE class_date <= DATE '{CUTOFF}' GROUP BY student_id""",
    "income": f"""
SELECT student_id, max(payment_date) AS latest, sum(amount) FILTER (WHERE payment_date {_within(90)}) AS amount,
       count(payment_id) FILTER (WHERE payment_date {_within(90)}) AS payments
FROM payments WHERE payment_date <= DATE '{CUTOFF}' AND {PAID} GROUP BY student_id""",
    "features": f"""
SELECT s.student_id, coalesce(s.plan, 'None') AS plan, coalesce(TRY_CAST(s.price_usd AS DOUBLE), 0) AS price_usd,
       greatest(0, coalesce({days("TRY_CAST(s.signup_date AS TIMESTAMP)")}, 0)) AS tenure_days,
       coalesce({days("c.latest")}, 9999) AS days_since_last_attendance,
       CAST(coalesce(c.days_30, 0) AS BIGINT) AS total_classes_30d,
       CAST(coalesce(c.days_60, 0) AS BIGINT) AS total_classes_60d,
       CAST(coalesce(c.days_90, 0) AS BIGINT) AS total_classes_90d,
       coalesce(CAST({days("i.latest")} AS DOUBLE) / 30.0, 9999.0) AS months_since_last_payment,
       CAST(coalesce(i.amount, 0) AS DOUBLE) AS payments_90d_usd,
       CAST(coalesce(i.payments, 0) AS BIGINT) AS n_payments_90d
FROM students s LEFT JOIN classes c USING (student_id) LEFT JOIN income i USING (student_id)""",
    "scored": f"SELECT *, ({' + '.join(SQL_TREES)}) / 3.0 AS churn_risk FROM features",
    "encoded": f"SELECT student_id, [{_ENCODED}] AS x FROM features",
    "phi": f"""
SELECT student_id, pos, sum(c) / 3.0 AS phi FROM (
  SELECT student_id, f1 AS pos, v * (o1 - z1) * CASE WHEN f2 IS NULL THEN 1.0 ELSE (z2 + o2) / 2 END AS c FROM walked
  UNION ALL
  SELECT student_id, f2, v * (o2 - z2) * (z1 + o1) / 2 FROM walked WHERE f2 IS NOT NULL
) GROUP BY student_id, pos""",
    "origins": "SELECT * FROM (VALUES "
    + ", ".join(
        [f"({i + 1}, '{c}', '{c}')" for i, c in enumerate(NUMBERS)]
        + [f"({len(NUMBERS) + i + 1}, 'plan', 'plan={c}')" for i, c in enumerate(CATEGORIES)]
    )
    + ") t(pos, feature, encoded_name)",
    "folded": """
SELECT student_id, feature, sum(abs(phi)) AS total, sum(phi) AS impact, min(pos) AS first
FROM phi JOIN origins USING (pos) WHERE abs(phi) > 1e-10 GROUP BY student_id, feature""",
    "explained": """
SELECT f.student_id, f.feature, f.impact, CASE WHEN f.impact > 0 THEN 'sube_riesgo' ELSE 'baja_riesgo' END AS effect,
       row_number() OVER (PARTITION BY f.student_id ORDER BY f.total DESC, f.first) AS place, s.churn_risk,
       regexp_replace(CASE f.feature WHEN 'plan' THEN s.plan """
    + " ".join(f"WHEN '{c}' THEN CAST(CAST(s.{c} AS DECIMAL(38,6)) AS VARCHAR)" for c in NUMBERS)
    + r""" END, '\.?0+$', '') AS value
FROM folded f JOIN scored s USING (student_id)""",
    "training": f"""
SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM payments p WHERE p.student_id = f.student_id AND {PAID}
   AND p.payment_date >= DATE '{ASOF}' AND p.payment_date < DATE '{ASOF}' + INTERVAL 90 DAY) THEN 0 ELSE 1 END AS abandono
FROM features f""",
    "labels_of": f"SELECT * FROM (VALUES {_LABELS}) t(feature, label)",
    "raisers": """
SELECT r.*, coalesce(l.label, r.feature) AS label,
       row_number() OVER (PARTITION BY record_id ORDER BY abs(impact) DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place
FROM reasons r LEFT JOIN labels_of l ON l.feature = r.feature WHERE lower(effect) = 'sube_riesgo'""",
    "normalized": """
SELECT r.record_id, CASE WHEN r.customer_id IS NOT NULL AND r.customer_id <> 0 THEN r.customer_id ELSE r.student_id END AS customer_id,
       r.asof_date, coalesce(r.prob_churn, 0.0) AS prob_churn, coalesce(t.n, 0) AS n_reasons,
       coalesce(t.txt, '') AS reasons_txt, coalesce(t.labels, '') AS labels_txt
FROM records r LEFT JOIN (
  SELECT record_id, count(*) AS n, string_agg(feature || ':' || label || ':' || printf('%.3f', impact) || ':' || value, '|' ORDER BY place) AS txt,
         string_agg(label, ', ' ORDER BY place) AS labels
  FROM raisers WHERE place <= 3 GROUP BY record_id) t USING (record_id)""",
    "picked": """
SELECT *, CASE WHEN prob_churn >= 0.7 THEN 'high' WHEN prob_churn >= 0.4 THEN 'medium' ELSE 'low' END AS tier
FROM normalized WHERE customer_id IS NOT NULL AND prob_churn BETWEEN 0 AND 1 AND n_reasons > 0""",
    "payload": """
SELECT p.*, coalesce(nullif(c.name, ''), 'Customer') AS name, trim(c.email) AS email, coalesce(c.plan, 'Monthly') AS plan,
       tier IN ('high', 'medium') AS eligible,
       CAST(p.customer_id AS VARCHAR) || CASE WHEN coalesce(asof_date, '') = '' THEN '' ELSE '|' || asof_date END AS idempotency_key
FROM picked p JOIN contacts c ON c.student_id = p.customer_id WHERE trim(c.email) <> ''""",
    "rendered": f"""
SELECT record_id, customer_id, email, tier, prob_churn, idempotency_key, left('Your place in Your plan, ' || name, 120) AS subject,
       array_to_string(['<p>' || p || '</p>' FOR p IN paragraphs], '') AS html_body,
       array_to_string(paragraphs, chr(10) || chr(10)) AS text_body
FROM (SELECT *, [p FOR p IN ['Reply YES to continue and we keep your place in Your plan (' || plan || ').',
    'This is what made us write to you: ' || labels_txt || '.',
    CASE WHEN eligible THEN 'The next invoice is 10 percent lower with the code SAVE10.' END,
    name || ', we are glad to have you with us.', 'Reply STOP to opt out of these messages.'] IF p IS NOT NULL] AS paragraphs FROM payload)""",
}

# The same steps for the records that the scoring itself makes.
STEPS |= {"own_reasons": ["explained", "labels_of"], "own_picked": ["scored", "own_reasons"], "own_payload": ["own_picked", "contacts"], "own_rendered": ["own_payload"]}
TEXTS["own_reasons"] = """
SELECT student_id, string_agg(label, ', ' ORDER BY place) AS labels_txt FROM (
  SELECT e.student_id, coalesce(l.label, e.feature) AS label, row_number() OVER (PARTITION BY e.student_id ORDER BY abs(e.impact) DESC, e.place) AS place
  FROM explained e LEFT JOIN labels_of l ON l.feature = e.feature WHERE e.place <= 5 AND e.effect = 'sube_riesgo')
WHERE place <= 3 GROUP BY student_id"""
TEXTS["own_picked"] = f"""
SELECT s.student_id AS record_id, s.student_id AS customer_id, s.churn_risk AS prob_churn, '{ASOF}' AS asof_date, r.labels_txt,
CASE WHEN s.churn_risk >= 0.7 THEN 'high' WHEN s.churn_risk >= 0.4 THEN 'medium' ELSE 'low' END AS tier
FROM scored s JOIN own_reasons r USING (student_id)"""
TEXTS["own_payload"] = TEXTS["payload"].replace("FROM picked p", "FROM own_picked p")
TEXTS["own_rendered"] = TEXTS["rendered"].replace("FROM payload", "FROM own_payload")

_PATH_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in row) + ")" for row in PATHS)
STEPS["walked"] = ["encoded"]
STEPS["phi"] = ["walked"]
TEXTS["walked"] = f"""
SELECT e.student_id, p.v, p.f1, p.z1, p.f2, p.z2,
       CASE WHEN x[f1] > lo1 AND x[f1] <= hi1 THEN 1.0 ELSE 0.0 END AS o1,
       CASE WHEN x[f2] > lo2 AND x[f2] <= hi2 THEN 1.0 ELSE 0.0 END AS o2
FROM encoded e CROSS JOIN (VALUES {_PATH_ROWS}) p(v, f1, lo1, hi1, z1, f2, lo2, hi2, z2)"""


def statement(select: str, *steps: str) -> str:
    """``select`` with the common table expressions it needs in front, in order of use."""
    order: list[str] = []

    def visit(name: str) -> None:
        for before in STEPS.get(name, []):
            visit(before)
        if name not in order:
            order.append(name)

    for s in steps:
        visit(s)
    parts = [f"{n} AS ({sql_view(n) if n in VIEWS else TEXTS[n]})" for n in order]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select
