"""Tables kept between steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all runs on one
    machine (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = os.path.join(tempfile.gettempdir(), "veilspark-checkpoints")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors do
    not take it with them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/veilspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
