"""Tables written for later steps, in the folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder in /tmp; a cluster gets an error, as its machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str = "hourloom") -> str:
    """A new folder under the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage is cut and nothing is computed twice."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
