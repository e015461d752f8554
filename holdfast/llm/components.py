"""Connected components of a table of links, for links that no machine holds alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import work_path

HEAVY_SHARE = 1024
# Links of components that Spark may join as it likes.
FEW_LINKS = 1 << 14


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, safe if executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(table: DataFrame) -> DataFrame:
    """The table, marked to be joined by a shuffle of both sides, whatever size Spark takes them for.

    Spark sizes a stored table by its compressed file and an exploded one by its rows before; a side that seems to be
    small on that account goes through the driver whole. Tables that grow with the input are joined by this.
    """
    return table.hint("merge")


def heavy(counts: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """The values of `key` with more than `total` / HEAVY_SHARE rows, and the number of `parts` to deal each to.

    Such keys are fewer than HEAVY_SHARE, so they may be broadcast however large the table is.
    """
    parts = F.ceil(F.col(rows) * HEAVY_SHARE / F.lit(max(1, total))).cast("int")
    return counts.where(is_heavy(rows, total)).select(key, parts.alias("parts"))


def is_heavy(rows: str, total: int) -> Column:
    return F.col(rows) * HEAVY_SHARE > total


def with_values(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, value: str) -> DataFrame:
    """`rows` with the `value` (never null) that `table` has for their key; NULL where it has none.

    `table` has one row per key and the `count` of rows with it, of `total` in all. Keys with a large share of them, which
    are few, are looked up in a broadcast table; the others are joined by a shuffle.
    """
    plain = table.select(key, value)
    large = F.broadcast(table.where(is_heavy(count, total)).select(key, value))
    rest = rows.join(large.select(key), key, "left_anti").join(merged(plain), key, "left")
    return rows.join(large, key).unionByName(rest)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links `a`-`b`; root is the smallest node that links reach.

    Labels shrink to the least one among the neighbours, then follow the label of the label, until none changes;
    a chain of n nodes takes about log n rounds. Sums per node are combined before the shuffle, so a node with many
    links costs a row per task. Null nodes are left out; an empty table gives an empty table.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = stored(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    side = merged if both.count() > FEW_LINKS else lambda table: table
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    while True:
        near = both.join(side(labels.select(F.col("node").alias("other"), F.col("root").alias("seen"))), "other")
        least = near.groupBy("node").agg(F.min("seen").alias("seen")).join(side(labels), "node")
        moved = least.select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # One job a round: both sides of the join share their shuffles.
        after = stored(moved.join(side(jump), "root").select("node", "old", F.col("next").alias("root")), "labels")
        changed = after.where("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
