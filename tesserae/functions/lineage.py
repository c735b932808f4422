"""Cutting the lineage of a table that many steps build on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where it may be unset, one of this process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), f"tesserae-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the checkpoint folder, so that lost executors do not repeat what led to them."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()
