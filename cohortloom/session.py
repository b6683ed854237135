"""Session helper and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cohortloom", cpus: str | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and the CLI."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if "SPARK_MASTER" not in os.environ:
        n = cpus or os.environ.get("BENCH_CPUS", "8")
        builder = (
            builder.master(f"local[{n}]")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", n)
        )
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        configured = tempfile.mkdtemp(prefix="cohortloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    Used between the rounds of iterative plans: a lost executor re-reads the
    checkpoint instead of replaying every earlier round.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    # A checkpoint keeps the constraints of its plan under attribute names it no longer
    # outputs, which breaks a later union; record it without constraints.
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several branches of one plan read (recomputable, spills to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
