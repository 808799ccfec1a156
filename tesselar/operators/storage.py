"""Where iterative operators cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a session on a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read back: any executor can be lost afterwards.

    checkpoint() would compute df twice, and keep the size that was estimated before, which loops multiply.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tesselar-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
