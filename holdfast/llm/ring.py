"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring of 64-bit positions. A row's key (doc_id) has a position, and the row belongs
to the next point clockwise, the end of its arc. Shards have capacities: what overflows a full shard goes on clockwise to
the next point whose shard has room. With capacities that sum up to the number of rows, all shards end up exactly full.

The rows of an arc are ranked by cells of a hash of the whole row, more of them in an arc with many rows, so that one key
is not one task's work. Only counts per arc and cell travel to the driver: 2 x points x cells numbers at most, whatever the
number of rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from holdfast.llm.components import stored

VIRTUAL = 64
CELLS = 32
CHUNK = 1000

_PLAN = StructType(
    [StructField("arc", IntegerType()), *[StructField(c, LongType()) for c in ("low", "high")], StructField("shard", IntegerType())]
    + [StructField("slot_base", LongType())]
)


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points in clockwise order, and the shard of each. A shard's points do not depend on the others."""
    points = sorted((xxhash.xxh3_64_intdigest(f"shard {s} point {v}") - 2**63, s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def spread(arc_rows: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, from rank, to rank, shard): which rows of each arc go to which shard.

    One walk clockwise from the first point gives every arc's rows to its owner while there is room and carries the rest
    along, first come first; the second walk places what is carried past the end.
    """
    room, waiting, given = capacity.astype(np.int64).copy(), deque(), []
    for turn in (0, 1):
        for arc, shard in enumerate(owners):
            if not turn and arc_rows[arc]:
                waiting.append([arc, 0, int(arc_rows[arc])])
            while waiting and room[shard]:
                origin, low, high = waiting[0]
                n = min(high - low, int(room[shard]))
                given.append((origin, low, low + n, int(shard)))
                room[shard] -= n
                waiting[0][1] += n
                if waiting[0][1] == high:
                    waiting.popleft()
    if waiting:
        raise ValueError("the capacities do not hold all rows")
    return given


def exact_capacity(rows: int, shards: int) -> np.ndarray:
    """Capacities at most one apart that sum up to the rows."""
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def arc_cells(rows: np.ndarray, points: int) -> np.ndarray:
    """How many cells each arc has: `CELLS`, times how often its rows hold the mean of all points."""
    return CELLS * np.maximum(1, rows * points // max(int(rows.sum()), 1))


def bounded_shards(documents: DataFrame, shards: int = 40, virtual: int = VIRTUAL, slack: float | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `slack` None: capacities are exact and the law is `rows` (counts at most one apart). Otherwise each shard may take
    (1 + slack) times the mean, so fewer rows move when the table or the ring grows, and law is null. Null text has size
    16 and the checksum 0; a null doc_id is a key like any other. Rows that repeat a doc_id are dealt like other rows.
    Slots count from 0 within a shard without gaps. grown_shard is null. Extra columns are ignored; an empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    positions, owners = ring(shards, virtual)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        at = np.searchsorted(positions, position.to_numpy(), side="left")
        return pd.Series((at % len(positions)).astype(np.int32))

    thin = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    same = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = F.xxhash64(F.lit("key"), "doc_id")
    keyed = same.withColumn("arc", arc_of(key)).withColumn("spread", F.xxhash64(F.lit("cell"), "doc_id", "size", "text_crc32"))
    # Equal rows are dealt in chunks, so that a row repeated without end is not one task's work.
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK)))
    keyed = keyed.withColumn("chunk", chunks)
    keyed = stored(keyed.withColumn("m", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK)).drop("copies"), "ring")

    arcs = keyed.groupBy("arc").agg(F.sum("m").alias("m")).toPandas()
    fine = arc_cells(arcs["m"].to_numpy(np.int64), len(owners))
    fine = spark.createDataFrame([(int(a), int(c)) for a, c in zip(arcs["arc"], fine, strict=True)], "arc int, cells long")
    keyed = keyed.join(F.broadcast(fine), "arc")  # one row per point at most
    keyed = keyed.withColumn("cell", F.pmod(F.pmod("spread", "cells") + F.col("chunk"), F.col("cells"))).drop("spread", "cells")
    cells = keyed.groupBy("arc", "cell").agg(F.sum("m").alias("m")).toPandas().sort_values(["arc", "cell"])
    cells["offset"] = (cells.groupby("arc")["m"].cumsum() - cells["m"]).astype("int64")
    arc_rows = np.zeros(len(owners), np.int64)
    np.add.at(arc_rows, cells["arc"].to_numpy(int), cells["m"].to_numpy(np.int64))
    total = int(arc_rows.sum())
    if slack is None:
        capacity = exact_capacity(total, shards)
    else:
        capacity = np.full(shards, int(np.ceil(total * (1 + slack) / shards)), np.int64)
    plan, filled = [], np.zeros(shards, np.int64)
    for arc, low, high, shard in spread(arc_rows, owners, capacity):
        plan.append((arc, low, high, shard, int(filled[shard]) - low))
        filled[shard] += high - low

    offsets = spark.createDataFrame(
        [(int(a), int(c), int(o)) for a, c, o in cells[["arc", "cell", "offset"]].itertuples(index=False)],
        "arc int, cell long, offset long",
    )
    before = Window.partitionBy("arc", "cell").orderBy("doc_id", "size", "text_crc32", "chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.join(F.broadcast(offsets), ["arc", "cell"])  # points x cells rows at most
    ranked = ranked.withColumn("first", F.col("offset") + F.coalesce(F.sum("m").over(before), F.lit(0)))
    each = ranked.withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("m") - 1)))
    slices = spark.createDataFrame(plan, _PLAN)
    dealt = each.join(F.broadcast(slices), "arc").where("rank >= low AND rank < high")  # points + shards rows at most
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if slack is None else None).cast("string").alias("law"),
        "shard",
        (F.col("slot_base") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_rows(documents: DataFrame, shards: int = 40, **settings) -> DataFrame:
    """All columns of the documents with those of `bounded_shards`, which win over columns of the same name.

    Rows that agree in id, size and checksum take the places dealt to them in any order. Few rows do as a rule; a row that is
    repeated without end is numbered in parts.
    """
    dealt = bounded_shards(documents, shards, **settings)
    key = ["doc_id", "size", "text_crc32"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    dealt = stored(dealt, "dealt")
    many = stored(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")

    single = _met(rows, dealt, key, many)
    repeated = _met(_numbered(rows, key, many), _numbered(dealt, key, many), [*key, "number"])
    added = [c for c in dealt.columns if c != "doc_id"]
    kept = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in added]
    return single.unionByName(repeated).select(*kept, *added)


def _equal(a: str, b: str, names: list[str]):
    found = F.lit(True)
    for c in names:
        found = found & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return found


def _met(rows: DataFrame, dealt: DataFrame, key: list[str], without: DataFrame | None = None) -> DataFrame:
    """Rows with what was dealt under the same key; keys in `without` are left out."""
    if without is not None:
        rows = rows.alias("r").join(without.alias("w"), _equal("r", "w", key), "left_anti")
        dealt = dealt.alias("d").join(without.alias("w"), _equal("d", "w", key), "left_anti")
    columns = [F.col(f"d.{c}").alias(c) for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return rows.alias("r").join(dealt.alias("d"), _equal("r", "d", key)).select(F.col("r.row").alias("row"), *columns)


def _numbered(rows: DataFrame, key: list[str], many: DataFrame) -> DataFrame:
    """The rows with a key of `many`, numbered from 1 under their key, in parts, so that no key fills a task."""
    mine = rows.alias("r").join(many.alias("m"), _equal("r", "m", key), "left_semi")
    # Written, so that both uses see the same parts.
    fixed = stored(mine.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(CHUNK))), "numbered")
    sizes = fixed.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(0)))
    placed = fixed.withColumn("inside", inside).alias("r").join(starts.alias("s"), _equal("r", "s", [*key, "part"]))
    columns = [F.col(f"r.{c}").alias(c) for c in rows.columns]
    return placed.select(*columns, (F.col("start") + F.col("inside")).alias("number"))
