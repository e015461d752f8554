"""A corpus from raw documents to shards, in five stages, each written and read again before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import group_join, language, mixing, ring, winnowing
from holdfast.session import work_path

LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_mark(docs: DataFrame) -> DataFrame:
    """Each row with its doc_id and a hash of its text, by which decisions find it again."""
    text = F.col("text").cast("string")
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no letters or fits no language clearly."""
    named = language.identify(docs.select(F.struct("*").alias("row"), "text"), language.learn(docs))
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return named.where(sure).select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays; of equal rows, one."""
    found = group_join.jaccard_components(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("first_id"), F.col("mark").alias("first_mark"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    kept = _with_mark(docs).join(first.distinct(), same, "left_semi")
    return kept.dropDuplicates(["id", "mark"]).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = winnowing.contamination(docs.select("doc_id", "text"), benchmark, with_mark=True).where("contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_mark"))
    return _with_mark(docs).join(bad, same, "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and forms meet their target shares of tokens."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with all its columns, its shard and its slot in it."""
    return ring.sharded_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

# Language models, raking and the ring are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made, path = stage(spark, docs, sf_dir), work_path(spark, f"stage-{i}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
