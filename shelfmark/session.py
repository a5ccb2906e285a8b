"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of its own only for a local session without it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Volumes whose files a task has open at once; rows of further ones are sorted by volume.
OPEN_VOLUMES = "spark.sql.maxConcurrentOutputFileWriters", "16"


def write_by_volume(df: DataFrame, where: str) -> None:
    """Parquet in a folder for each volume, in the order in which rows come: no task sorts its rows for that."""
    conf, (name, n) = df.sparkSession.conf, OPEN_VOLUMES
    had = conf.get(name, None)
    conf.set(name, n)
    try:
        df.write.partitionBy("volume_id").parquet(where)
    finally:
        conf.unset(name) if had is None else conf.set(name, had)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()
