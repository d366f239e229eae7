"""Cutting the lineage of what a loop builds up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a temporary one is set where spark.checkpoint.dir names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in that folder."""
    shared(df.sparkSession)
    return df.checkpoint()
