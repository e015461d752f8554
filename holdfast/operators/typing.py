"""Column types of text tables: inference, coercion, schema evolution, row ids, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import dates, values
from holdfast.session import materialize

# Type label -> Spark type.
SPARK_TYPES = {
    "TINYINT(1)": "tinyint",
    "INT": "int",
    "BIGINT": "bigint",
    "DECIMAL(18,6)": "decimal(18,6)",
    "DATETIME": "timestamp_ntz",
    "DATE": "date",
    "VARCHAR(255)": "string",
    "TEXT": "string",
    "LONGTEXT": "string",
}
RESCUED = "_rescued"
ROW_ID = "_row_id"


def value_predicates(c: Column) -> dict[str, Column]:
    """What a trimmed, non-blank text looks like."""
    return {
        "is_bool": values.is_bool(c),
        "is_int": values.is_int(c),
        "is_decimal": values.is_decimal_not_int(c),
        "is_datetime": dates.parse_datetime(c).isNotNull(),
        "is_date": dates.parse_date(c).isNotNull(),
    }


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (position, column_name, type_label) per text column: the first type all its non-blank
    values satisfy, from one pass over all rows.

    Values are unpivoted and combined per column before the shuffle, which carries one row per column
    and task.
    """
    columns = columns or df.columns
    source = df.select(*[F.col(f"`{c}`") for c in columns])
    pairs = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.col(f"`{c}`").cast("string").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    v = F.col("v")
    looks = value_predicates(v)
    tested = (
        source.select(F.inline(pairs))
        .select("position", values.blank_to_null(F.col("value")).alias("v"))
        .select(
            "position",
            F.length(v).alias("length"),
            looks["is_bool"].alias("bool"),
            looks["is_int"].alias("int"),
            values.fits_int32(v).alias("int32"),
            v.rlike(values.DECIMAL_PATTERN).alias("number"),
            looks["is_datetime"].alias("datetime"),
            looks["is_date"].alias("date"),
        )
    )
    # NULL for a blank value, which then counts for no test.
    tests = ("bool", "int", "int32", "number", "datetime", "date")
    every = tested.groupBy("position").agg(
        F.count("length").alias("filled"),
        F.max("length").alias("longest"),
        *[F.bool_and(F.when(F.col("length").isNotNull(), F.col(t))).alias(t) for t in tests],
    )
    label = (
        F.when(F.col("filled") == 0, "VARCHAR(255)")
        .when(F.col("bool"), "TINYINT(1)")
        .when(F.col("int"), F.when(F.col("int32"), "INT").otherwise("BIGINT"))
        .when(F.col("number"), "DECIMAL(18,6)")
        .when(F.col("datetime"), "DATETIME")
        .when(F.col("date"), "DATE")
        .when(F.col("longest") > 1000, "LONGTEXT")
        .when(F.col("longest") > 255, "TEXT")
        .otherwise("VARCHAR(255)")
    )
    # A table without rows gives no groups; every column is listed all the same.
    names = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name")) for i, c in enumerate(columns)])
    listed = df.sparkSession.range(1).select(F.inline(names))
    return listed.join(every.select("position", label.alias("type_label")), "position", "left").select(
        "position", "column_name", F.coalesce("type_label", F.lit("VARCHAR(255)")).alias("type_label")
    )


def schema_of(inferred: DataFrame) -> dict[str, str]:
    """Column -> type label; one row per column reaches the driver."""
    return {r["column_name"]: r["type_label"] for r in inferred.orderBy("position").collect()}


def label_of(spark_type: str) -> str:
    """The label of a column that is there already; texts of any length stay texts."""
    labels = {kind: label for label, kind in SPARK_TYPES.items() if kind != "string"}
    return labels.get(spark_type, "LONGTEXT")


def coerce_value(v: Column, label: str) -> Column:
    """Typed value of a stripped, non-blank text."""
    if label == "TINYINT(1)":
        return values.bool_to_bit(v)
    if label in ("INT", "BIGINT"):
        return values.to_int(v, SPARK_TYPES[label])
    if label.startswith("DECIMAL"):
        return F.when(v.rlike(values.DECIMAL_PATTERN), v.try_cast(SPARK_TYPES[label]))
    if label == "DATE":
        return dates.parse_date(v)
    if label == "DATETIME":
        return dates.parse_datetime(v)
    return v


def _keeps_raw(label: str) -> bool:
    return label in ("TINYINT(1)", "INT", "BIGINT") or label.startswith("DECIMAL")


def coerce_rows(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Typed columns for the names in ``schema``; other columns pass through.

    A text that does not fit a boolean, integer or decimal column becomes NULL and is kept in the
    map column ``_rescued`` (NULL when the whole row fits). A text that is no date becomes NULL.
    """
    # Three projections, so that each text is stripped once and each value is typed once.
    names = {c: f"_text_{i}" for i, c in enumerate(df.columns) if c in schema}
    others = [F.col(f"`{c}`") for c in df.columns if c not in schema]
    texts = df.select(*others, *[values.blank_to_null(F.col(f"`{c}`")).alias(t) for c, t in names.items()])
    raw = {c: t for c, t in names.items() if _keeps_raw(schema[c])}
    typed = texts.select(
        *others,
        *[coerce_value(F.col(t), schema[c]).alias(c) for c, t in names.items()],
        *[F.col(t) for t in raw.values()],
    )
    if raw:
        left_over = F.array(
            *[
                F.struct(F.lit(c).alias("key"), F.col(t).alias("value"))
                for c, t in raw.items()
            ]
        )
        unfit = [F.col(t).isNotNull() & F.col(f"`{c}`").isNull() for c, t in raw.items()]
        any_unfit = unfit[0]
        for u in unfit[1:]:
            any_unfit = any_unfit | u
        fits = F.array(*unfit)
        kept = F.filter(left_over, lambda e, i: F.get(fits, i))
        rescued = F.when(any_unfit, F.map_from_entries(kept))
    else:
        rescued = F.lit(None).cast("map<string,string>")
    return typed.select(*[F.col(f"`{c}`") for c in df.columns], rescued.alias(RESCUED))


def evolve(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append with additive evolution: new columns are added, absent ones are NULL."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Unique (not dense) key without a shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id() + 1)


def with_dense_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Key 1..n without a shuffle of the rows.

    The rows are checkpointed first, so both passes see the same partitions. The generated id holds
    the row's position in its partition in the low 33 bits; one count per partition gives the start.
    """
    fixed = materialize(df)
    part, place = "_part", "_place"
    numbered = fixed.withColumn(part, F.spark_partition_id()).withColumn(
        place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = {r[part]: r["count"] for r in numbered.groupBy(part).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    # One start per partition of this table: bounded by the partition count, not by the rows.
    start = F.get(values.literal_bigints(starts), F.col(part))
    return numbered.withColumn(name, start + F.col(place) + 1).drop(part, place)


MOST_BROADCAST_SPLITS = 1_000_000


def scan_row_ids(scan: DataFrame, start: int = 0, name: str = ROW_ID) -> DataFrame:
    """Key start+1..start+n for the rows of a file scan, without a shuffle and without writing the rows first.

    ``scan`` reads files and may project or filter. A first pass counts the rows of every split of every file, in order of
    file and position; the second adds a row's place in its split to the rows before the split. Both passes cut the files
    in the same way; a row of a split that the first one has not seen raises an error. Only one row per split reaches the driver.
    """
    part, split, place, file = "_part", "_split", "_place", "_metadata.file_path"
    columns = [f"`{c}`" for c in scan.columns]
    marks = [
        F.spark_partition_id().alias(part),
        F.struct(F.col(file).alias("file"), F.col("_metadata.file_block_start").alias("at")).alias(split),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place),
    ]
    key = F.xxhash64(f"{split}.file", f"{split}.at", part)
    counted = scan.select(*marks).groupBy(part, split).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    found = sorted(counted.select(key.alias("key"), split, "n", "first").collect(), key=lambda r: (r[split].file, r[split].at, r["first"]))
    bases, total = [], start
    for r in found:
        bases.append((r["key"], total - r["first"]))
        total += r["n"]
    table = scan.sparkSession.createDataFrame(bases, "_key long, _base long")
    if len(bases) <= MOST_BROADCAST_SPLITS:
        table = F.broadcast(table)
    numbered = scan.select(*columns, *marks).withColumn("_key", key).join(table, "_key", "left")
    lost = F.raise_error(F.lit("the files were cut in another way between the two passes")).cast("bigint")
    return numbered.select(*columns, (F.coalesce("_base", lost) + F.col(place) + 1).alias(name))


def table_columns(tables: dict[str, DataFrame], filled: bool = False) -> DataFrame:
    """Columns of tables: name, position and type, from the schemas alone; on demand the number of non-NULL values."""
    out = None
    for table, df in tables.items():
        fields = list(enumerate(df.schema))
        entries = F.array(
            *[
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(i + 1).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    *([F.col(f"c{i}").alias("filled")] if filled else []),
                )
                for i, f in fields
            ]
        )
        one = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in fields]) if filled else df.sparkSession.range(1)
        rows = one.select(F.inline(entries))
        out = rows if out is None else out.unionByName(rows)
    return out


def label_count(df: DataFrame, target: str = "abandono") -> DataFrame:
    """Number of rows whose target, read as an integer, is 1."""
    return df.agg(F.count_if(F.col(target).try_cast("int") == 1).alias("positives"))
