"""What iterative plans share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of spark.checkpoint.dir; where it is unset, a local one in local mode and an error elsewhere."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gleaner-")
    spark.sparkContext.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables of a query's own."""
    checkpoint_folder(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
