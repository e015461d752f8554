"""Substring search over names and e-mails by an index of trigrams.

The index has a row per trigram of a student's lower-cased fields. A search reads the postings of the rarest trigrams of its
text, keeps the students that have all of them, and verifies these by the substring itself. So its result is that of
scanning all students, while it reads the few files whose trigram ranges hold the ones it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.text import contains_ignoring_case

FIELDS = ("name", "email")
GRAM = 3
RAREST = 3
# A task sorts or counts so many postings, however many there are.
POSTINGS_PER_TASK = 1_000_000


def _grams(c: Column) -> Column:
    """All runs of three characters of a text, lower-cased; none for shorter texts and NULL."""
    low = F.lower(c)
    last = F.length(low) - GRAM + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM)))


def write_index(students: DataFrame, path: str, key: str = "student_id", fields: Sequence[str] = FIELDS, files: int | None = None) -> str:
    """Postings (gram, key) in ranges of gram and key, so that a frequent trigram is spread, and the number of postings per gram."""
    spark = students.sparkSession
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(f)) for f in fields])))
    n = files
    if n is None:
        total = students.agg(F.sum(F.size(grams))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POSTINGS_PER_TASK))
    # A file of students has many times its bytes of postings, so the students are dealt to tasks first.
    dealt = students.select(key, *fields).repartition(n, key, *fields)
    postings = dealt.select(F.explode(grams).alias("gram"), F.col(key)).repartitionByRange(n, "gram", key).distinct()
    postings.sortWithinPartitions("gram", key).write.mode("overwrite").parquet(f"{path}/postings")
    kept = spark.read.parquet(f"{path}/postings")
    counts = kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(max(1, n // 8), "gram")
    counts.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return path


def matches(df: DataFrame, text: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows with a field that contains the text, in any case."""
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(contains_ignoring_case(F.col(f), text), F.lit(False))
    return df.where(found)


def search(
    spark: SparkSession, path: str, students: DataFrame, text: str, key: str = "student_id", fields: Sequence[str] = FIELDS, rarest: int = RAREST
) -> DataFrame:
    """The students with a field that contains the text. Texts of fewer than three characters are looked for by a scan.

    Rows of ``students`` without a key are found too, and rows that share one are each verified.
    """
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return matches(students, text, fields)
    # A row per trigram of the text at most.
    known = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return students.limit(0)
    rows = sorted(known, key=lambda r: (r["n"], r["gram"]))[:rarest]
    chosen, tasks = [r["gram"] for r in rows], -(-sum(r["n"] for r in rows) // POSTINGS_PER_TASK)
    postings = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(chosen)).repartition(max(1, tasks), key)
    holders = postings.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(chosen))
    return matches(students.join(holders, F.col(key).eqNullSafe(F.col("_key")), "left_semi"), text, fields)


def with_result_count(found: DataFrame, name: str = "results") -> DataFrame:
    """The rows of a result with their number next to each."""
    return found.withColumn(name, found.agg(F.count(F.lit(1))).scalar())
