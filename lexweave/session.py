"""Session helpers: checkpoint folder and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (local tests) a temporary folder is set, once a session;
    on a cluster that is an error, as executors would write to disks of their own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("lexweave.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("lexweave.checkpoint.dir", own)
    return own


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a staged table."""
    return f"{shared_dir(spark).rstrip('/')}/lexweave-{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
