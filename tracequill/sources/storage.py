"""Shared storage: cutting lineage so that what is read twice is the same rows in the same partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_set: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where the driver is the only executor."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracequill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder once, with its partitions."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _set:
        spark.sparkContext.setCheckpointDir(scratch(spark))
        _set.add(app)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written once as zstd Parquet and read back, for tables that are read several times."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
