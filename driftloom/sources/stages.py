"""Stages: results written to the shared folder and read back, which cuts the lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a temporary folder, and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("driftloom.local.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("driftloom.local.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    at = f"{shared_folder(df.sparkSession)}/driftloom/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
