"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="riskbook-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once and read again: what follows doesn't run the steps before it anew, also after the loss of an executor."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
