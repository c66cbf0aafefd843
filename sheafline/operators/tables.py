"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no spark.checkpoint.dir, as in tests.
LOCAL = "/tmp/checkpoints/sheafline"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs a folder that driver and executors share: set spark.checkpoint.dir")
    return (named or LOCAL).rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table that any executor can read; its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
