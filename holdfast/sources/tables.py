"""Tables: parameterised queries, append and overwrite, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows per insert batch.
BATCH_SIZE = 1000


def query(spark: SparkSession, text: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """SQL text with named parameters (``:name``) over DataFrames given by name."""
    return spark.sql(text, args=params or {}, **views)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Append (or replace) a parquet table; the row count comes from the same job."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite" if overwrite else "append").parquet(path)
    return int(seen.get["rows"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may have gained columns over time; absent ones are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def jdbc_scan(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Database table; with a key and its bounds it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def jdbc_append(df: DataFrame, url: str, table: str, overwrite: bool = False, **options: str) -> None:
    writer = df.write.format("jdbc").mode("overwrite" if overwrite else "append")
    writer.options(url=url, dbtable=table, batchsize=BATCH_SIZE, **options).save()
