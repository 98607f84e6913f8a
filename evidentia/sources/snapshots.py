"""Whether files stay as they are while a job reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, folder: str, pattern: str = "*.hwpx") -> DataFrame:
    """(path, length, time) of the files below a folder as they are now; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("time"))


def hashes(spark: SparkSession, folder: str, pattern: str = "*.hwpx", most_bytes: int = 1 << 30) -> DataFrame:
    """(path, sha256) of the same files up to a size, read again."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("length") <= most_bytes).select("path", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path): files of ``before`` that are gone in ``after``, or have another length or time."""
    now = after.select("path", F.col("length").alias("length_now"), F.col("time").alias("time_now"))
    joined = before.join(now, "path", "left")
    return joined.where(~(F.col("length").eqNullSafe(F.col("length_now")) & F.col("time").eqNullSafe(F.col("time_now")))).select("path")
