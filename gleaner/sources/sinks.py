"""Writers: tables swapped in whole, JSON lines and TSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def swap(table: DataFrame, path: str) -> None:
    """Writes beside ``path`` and renames, so that a reader never sees half a table; ``table`` may read from ``path``."""
    spark = table.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    table.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had:
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop(spark, path)
    return fs.exists(target)


CURRENT = "current"


def pointed_at(spark: SparkSession, folder: str) -> str | None:
    """The name of the version that ``folder`` holds now."""
    target, fs = _hadoop(spark, f"{folder}/{CURRENT}")
    return spark.read.text(f"{folder}/{CURRENT}").first()[0] if fs.exists(target) else None


def point_to(spark: SparkSession, folder: str, name: str) -> None:
    """Makes ``name`` the version that ``folder`` holds, by one rename, and deletes the one before."""
    old = pointed_at(spark, folder)
    fresh, fs = _hadoop(spark, f"{folder}/{CURRENT}.{name}")
    out = fs.create(fresh, True)
    out.writeBytes(name)
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(_hadoop(spark, f"{folder}/{CURRENT}")[0]), options)
    if old and old != name:
        fs.delete(_hadoop(spark, f"{folder}/{old}")[0], True)


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, NULL fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
