"""Explanations in terms of the original features, for all students at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions import values

# Smallest contribution that counts, names of the two directions.
NOISE = 1e-10
RAISES = "sube_riesgo"
LOWERS = "baja_riesgo"
UNKNOWN = "<unk>"
BACKGROUND_ROWS = 300
BACKGROUND_SEED = 42


def encoded_names(numeric: Sequence[str], categories: dict[str, Sequence[str]]) -> list[str]:
    """Encoded columns in order: numbers as they are, then ``column=category``."""
    return [*numeric, *[f"{c}={v}" for c, vs in categories.items() for v in vs]]


def encoded_origins(numeric: Sequence[str], categories: dict[str, Sequence[str]]) -> list[str]:
    """Original feature of every encoded column."""
    return [*numeric, *[c for c, vs in categories.items() for _ in vs]]


def feature_map(spark: SparkSession, numeric: Sequence[str], categories: dict[str, Sequence[str]]) -> DataFrame:
    rows = list(zip(encoded_names(numeric, categories), encoded_origins(numeric, categories)))
    return spark.createDataFrame(
        [(i, name, origin) for i, (name, origin) in enumerate(rows)],
        "position int, encoded_name string, orig_feature string",
    )


def encode(df: DataFrame, numeric: Sequence[str], categories: dict[str, Sequence[str]], out: str = "x") -> DataFrame:
    """Vector of the aligned features as an array; a category that is not listed is all zeros."""
    parts = [F.col(c).cast("double") for c in numeric]
    for name, options in categories.items():
        parts += [F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in options]
    return df.withColumn(out, F.array(*parts))


def background_sample(df: DataFrame, n: int = BACKGROUND_ROWS, seed: int = BACKGROUND_SEED, order: Column | None = None):
    """Exactly n rows (all, if there are no more), the same on every run, picked by a hash of the id."""
    chosen = F.xxhash64("student_id", F.lit(seed)) if order is None else order
    return df.orderBy(chosen, "student_id").limit(n)


def _blocks(origins: Sequence[str]) -> list[tuple[str, int, int]]:
    """(feature, first position, length) of each run of encoded columns, features in first-seen order."""
    runs: list[tuple[str, int, int]] = []
    for i, name in enumerate(origins):
        if runs and runs[-1][0] == name:
            runs[-1] = (name, runs[-1][1], runs[-1][2] + 1)
        else:
            runs.append((name, i, 1))
    return runs


def display_value(df: DataFrame, name: str) -> Column:
    """A feature value as text: category as is, number without trailing zeros."""
    if dict(df.dtypes).get(name) == "string":
        return F.col(name)
    return values.plain_number(F.col(name))


def local_reasons(
    df: DataFrame, origins: Sequence[str], contract: Sequence[str], phi: str = "phi", top_k: int = 5, out: str = "reasons"
) -> DataFrame:
    """The top-k original features per row by summed absolute contribution, folded inside the row.

    Noise and unmapped columns do not count. If nothing is left, the contract's names are paired with
    the contributions by position.
    """
    vector = F.col(phi)
    best, fallback = "_best", "_fallback"

    def entry(order: Column, rank: int, name: str, impact: Column) -> Column:
        return F.struct(
            order.alias("order"),
            F.lit(rank).alias("rank"),
            F.lit(name).alias("feature"),
            impact.alias("impact"),
            display_value(df, name).alias("value"),
        )

    def loud(v: Column, size: Column) -> Column:
        return F.when(F.abs(v) > NOISE, size).otherwise(0.0)

    entries = []
    for rank, (name, first, length) in enumerate(r for r in _blocks(origins) if r[0] != UNKNOWN):
        if length == 1:
            v = vector[first]
            total, net = loud(v, F.abs(v)), loud(v, v)
        else:
            block = F.slice(vector, first + 1, length)
            total = F.aggregate(block, F.lit(0.0), lambda acc, v: acc + loud(v, F.abs(v)))
            net = F.aggregate(block, F.lit(0.0), lambda acc, v: acc + loud(v, v))
        entries.append(entry(-total, rank, name, net))
    quiet = [
        entry(-F.abs(vector[i]), i, name, vector[i]) for i, name in enumerate(list(contract)[: len(origins)])
    ]
    # Only a loud entry has a total above 0. The two columns keep each array from being built twice.
    ranked = df.withColumn(best, F.slice(F.array_sort(F.array(*entries)), 1, top_k)).withColumn(
        fallback, F.when(F.col(best)[0]["order"] < 0, F.lit(None)).otherwise(F.slice(F.array_sort(F.array(*quiet)), 1, top_k))
    )
    kept = F.coalesce(F.col(fallback), F.filter(F.col(best), lambda e: e["order"] < 0))
    return ranked.withColumn(
        out,
        F.transform(
            kept,
            lambda e: F.struct(
                e["feature"].alias("feature"),
                e["impact"].alias("impact"),
                F.when(e["impact"] > 0, RAISES).otherwise(LOWERS).alias("effect"),
                e["value"].alias("value"),
            ),
        ),
    ).drop(best, fallback)


def column_statistics(df: DataFrame, phi: str = "phi") -> DataFrame:
    """Per encoded column: sum and mean of the absolute contribution and mean contribution.

    The outer form of explode keeps Spark from testing the array's size first, which would compute the
    contributions a second time.
    """
    return (
        df.select(F.posexplode_outer(phi).alias("position", "value"))
        .filter(F.col("position").isNotNull())
        .groupBy("position")
        .agg(
            F.sum(F.abs("value")).alias("sum_abs"),
            F.avg(F.abs("value")).alias("mean_abs"),
            F.avg("value").alias("net_mean"),
        )
    )


def at_position(names: Sequence[str], position: Column) -> Column:
    """Name of an encoded column: a lookup in a literal array, so that no join shuffles rows by position."""
    return F.get(F.array(*[F.lit(n) for n in names]), position)


def global_importance(df: DataFrame, origins: Sequence[str], phi: str = "phi") -> DataFrame:
    """Ranked original features: sum of the sums, plain mean of the means over their encoded columns.

    Everything after the first aggregation has one row per encoded column.
    """
    by_feature = (
        column_statistics(df, phi)
        .groupBy(F.coalesce(at_position(origins, F.col("position")), F.lit(UNKNOWN)).alias("orig_feature"))
        .agg(
            F.sum("sum_abs").alias("global_sum_abs_shap"),
            F.avg("mean_abs").alias("global_mean_abs_shap"),
            F.avg("net_mean").alias("global_net"),
        )
        .filter(F.col("orig_feature") != UNKNOWN)
    )
    best = Window.orderBy(F.desc("global_sum_abs_shap"), "orig_feature")
    return by_feature.withColumn("rank", F.row_number().over(best))
