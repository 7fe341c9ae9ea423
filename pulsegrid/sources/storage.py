"""Where jobs keep what they cut their lineage with."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's shared folder (spark.checkpoint.dir); where that is unset a local one, if all tasks run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared store."""
    import uuid

    with_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "step") -> DataFrame:
    """Writes df to the shared store and reads it back: what follows is computed from there, however often."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
