"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings of a running session. Generated methods above 8,000 bytes of bytecode are not compiled to
# machine code by the JVM; under the limit Spark falls back to smaller methods, which are. Wide text
# coercions and message rules run two to four times faster for it.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "holdfast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; extra settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_CONF,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Name it in the session's settings: there is no default, as a folder of one machine would lose rows on a cluster.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        current = sc._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if not configured:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/holdfast/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows and their partitioning stay the same if executors are lost."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
