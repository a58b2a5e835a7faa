"""Session helpers: the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; one of this process where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = os.path.join(tempfile.gettempdir(), f"practicum-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
