"""Python workers and this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Prepare the session for operators that run Python on the executors.

    Workers import this package from the folder the driver has it from, if they are told no other place; a cluster whose
    machines do not share that folder gets the package by ``--py-files``.  Batches of rows with long texts are kept small:
    1,000 rows, unless the session asks for another number than Spark's default.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder that the session names; a temporary one only on a single machine that names none (tests)."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: what is computed so far is written to the shared folder and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
