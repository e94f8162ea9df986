"""Incremental indexing: arriving pages are tokenised and upserted into the document table.

The engine's corpus statistics change with every page, so scores are computed
when the index is built from the document table; a stream only keeps that table
up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.sources.sinks import swap


def documents_of(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.size(text.tokenize(F.col("text"))).alias("length"), text.tokenize(F.col("text")).alias("terms"), "fetched_at")


def merge(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Puts a batch into the table at ``path``: the latest fetch of a url wins."""
    fresh = documents_of(batch)
    try:
        fresh = spark.read.parquet(path).unionByName(fresh)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"))
    swap(fresh.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"), path)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Starts the stream of (url, text, fetched_at); returns the query."""
    spark = stream.sparkSession
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: merge(spark, path, b)).trigger(availableNow=True).start()
