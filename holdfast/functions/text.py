"""Small text expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model column -> reason label.
REASON_LABELS = {
    "months_since_last_payment": "atraso_pago",
    "payments_90d_usd": "bajo_pago_reciente",
    "plan": "plan_inadecuado",
    "price_usd": "precio_alto",
    "total_classes_90d": "bajo_uso_3m",
    "days_since_last_attendance": "inactividad_reciente",
    "total_classes_60d": "bajo_uso_2m",
    "total_classes_30d": "bajo_uso_1m",
}


def reason_label(feature: Column, labels: Mapping[str, str] = REASON_LABELS) -> Column:
    """Label of a feature; a feature without one keeps its name."""
    if not labels:
        return feature
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), feature), feature)


def initials(name: Column) -> Column:
    """First letters of the first two words, in upper case."""
    letters = F.transform(F.split(name, " "), lambda word: F.left(word, F.lit(1)))
    return F.upper(F.substring(F.array_join(letters, ""), 1, 2))


def contains_ignoring_case(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower()))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
