"""Small texts on the file system that Spark itself uses, so that driver and executors mean the same place."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the old or the new text: it is written under another name and renamed over the target."""
    system, place = _place(spark, path)
    part = place.suffix(".part")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(part, place, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """None if there is no such file, or nothing in it."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] or None if row else None
