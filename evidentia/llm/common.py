"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidentia.workers import checkpointed, ready, shared_folder

__all__ = ["checkpointed", "partitions", "read", "shared_folder", "stored"]

#: Splits below which a table is dealt anew; a large one is always read as it lies.
FEW_SPLITS = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; only Spark opens the path, so any store will do.

    A small table can be one split however many cores wait; such a one is dealt to all of them.
    """
    ready(spark)
    rows, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else rows


def stored(df: DataFrame) -> DataFrame:
    """The same as checkpointed, as compressed Parquet: for larger intermediate tables of which columns are read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
