"""Where intermediate tables go: folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession, name: str) -> str:
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if base is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base or tempfile.mkdtemp(prefix=f"quarry-{name}-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint directory (a temporary one where that is unset, as in tests)."""
    return f"{_base(spark, name)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_base(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)
