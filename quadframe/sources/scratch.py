"""Tables in the folder that driver and executors share: cutting lineage, and intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a local master, one folder of this process. A cluster must set it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-quadframe-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
