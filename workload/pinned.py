"""A small forest with fixed nodes, once as node table and once in SQL terms.

Three trees of depth two. Vector positions: nine numbers, then one column per plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from holdfast.operators.explain import encoded_names
from holdfast.operators.features import CATEGORICAL, FEATURES, NUMERIC
from holdfast.operators.forest import Forest, build_forest, nodes_from_rows

CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "None"]

CONTRACT = {
    "feature_order": [c for c in FEATURES if c != "student_id"],
    "numeric_cols": NUMERIC,
    "categorical_cols": CATEGORICAL,
    "categories": {"plan": CATEGORIES},
}

# tree, node, feature position, threshold, left, right, value, cover
NODES = [
    (0, 0, 2, 60.0, 1, 2, None, 1000.0),
    (0, 1, 5, 1.0, 3, 4, None, 640.0),
    (0, 2, 7, 0.0, 5, 6, None, 360.0),
    (0, 3, None, None, None, None, 0.3, 400.0),
    (0, 4, None, None, None, None, 0.1, 240.0),
    (0, 5, None, None, None, None, 0.9, 300.0),
    (0, 6, None, None, None, None, 0.45, 60.0),
    (1, 0, 1, 1500.0, 1, 2, None, 1000.0),
    (1, 1, 10, 0.5, 3, 4, None, 300.0),
    (1, 2, 6, 6.0, 5, 6, None, 700.0),
    (1, 3, None, None, None, None, 0.6, 220.0),
    (1, 4, None, None, None, None, 0.8, 80.0),
    (1, 5, None, None, None, None, 0.2, 250.0),
    (1, 6, None, None, None, None, 0.75, 450.0),
    (2, 0, 6, 3.0, 1, 2, None, 1000.0),
    (2, 1, 6, 1.0, 3, 4, None, 150.0),
    (2, 2, 0, 4000.0, 5, 6, None, 850.0),
    (2, 3, None, None, None, None, 0.05, 50.0),
    (2, 4, None, None, None, None, 0.15, 100.0),
    (2, 5, None, None, None, None, 0.55, 400.0),
    (2, 6, None, None, None, None, 0.85, 450.0),
]

SQL_TREES = [
    "(CASE WHEN days_since_last_attendance <= 60 THEN CASE WHEN total_classes_90d <= 1 THEN 0.3::DOUBLE ELSE 0.1 END "
    "ELSE CASE WHEN payments_90d_usd <= 0 THEN 0.9 ELSE 0.45 END END)",
    "(CASE WHEN tenure_days <= 1500 THEN CASE WHEN plan <> 'BUILDING' THEN 0.6::DOUBLE ELSE 0.8 END "
    "ELSE CASE WHEN months_since_last_payment <= 6 THEN 0.2 ELSE 0.75 END END)",
    "(CASE WHEN months_since_last_payment <= 3 THEN CASE WHEN months_since_last_payment <= 1 THEN 0.05::DOUBLE ELSE 0.15 END "
    "ELSE CASE WHEN price_usd <= 4000 THEN 0.55 ELSE 0.85 END END)",
]

_LOW, _HIGH = "-1e300", "1e300"
# value, then (position from 1, above, up to, share) for one or two features
PATHS = [
    (0.3, 3, _LOW, 60, 0.64, 6, _LOW, 1, 0.625),
    (0.1, 3, _LOW, 60, 0.64, 6, 1, _HIGH, 0.375),
    (0.9, 3, 60, _HIGH, 0.36, 8, _LOW, 0, "300.0/360"),
    (0.45, 3, 60, _HIGH, 0.36, 8, 0, _HIGH, "60.0/360"),
    (0.6, 2, _LOW, 1500, 0.3, 11, _LOW, 0.5, "220.0/300"),
    (0.8, 2, _LOW, 1500, 0.3, 11, 0.5, _HIGH, "80.0/300"),
    (0.2, 2, 1500, _HIGH, 0.7, 7, _LOW, 6, "250.0/700"),
    (0.75, 2, 1500, _HIGH, 0.7, 7, 6, _HIGH, "450.0/700"),
    (0.05, 7, _LOW, 1, 0.05, None, None, None, None),
    (0.15, 7, 1, 3, 0.1, None, None, None, None),
    (0.55, 7, 3, _HIGH, 0.85, 1, _LOW, 4000, "400.0/850"),
    (0.85, 7, 3, _HIGH, 0.85, 1, 4000, _HIGH, "450.0/850"),
]


def pinned_forest(spark: SparkSession) -> Forest:
    names = encoded_names(CONTRACT["numeric_cols"], CONTRACT["categories"])
    return build_forest(nodes_from_rows(spark, NODES), names)
