"""Continuous scanning: a folder of documents as a stream of archives, reports written batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.report import as_json
from evidentia.plans.scan import scan_documents
from evidentia.sources.catalog import Catalog

FILES = "path string, modificationTime timestamp, length long, content binary"


def scan_folder(spark: SparkSession, folder: str, catalog: Catalog, as_of: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Scan what is in the folder and has not been scanned before; every batch appends (path, json) rows.

    A batch that is run again after a failure replaces what it had written, so each document has one report.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.hwpx").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch, number: int) -> None:
        as_json(scan_documents(batch.sparkSession, batch, catalog, as_of)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
