"""Session helpers: durable lineage cuts and a small local session for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str | None:
    """The shared folder for written stages, or None on a cluster without one.

    ``spark.checkpoint.dir`` names it. Only a local session (tests) gets one of
    its own where that is unset: a machine-local folder on a cluster would be
    lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="visitframe-"))
        folder = context.getCheckpointDir()
    return folder


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the stage folder. On a cluster without a shared folder it raises."""
    folder = stage_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the stage folder and read it back.

    Used at stage boundaries whose result is read more than once. A written
    table, unlike a plain checkpoint, keeps column pruning and size
    statistics. On a cluster without a shared folder it raises: the stage
    would be computed anew for each use.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = "*", name: str = "visitframe") -> SparkSession:
    """Session for tests and the benchmark."""
    partitions = "8" if cpus == "*" else str(cpus)
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
