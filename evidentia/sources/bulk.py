"""Catalogs, reports and ledgers in any number: a strict table function over files, one row or one refusal each.

A file is one of ``binaryFile`` (path, length, content), or any row of (path, content).  Files beyond the size bound are refused by
their length, before their content is read; whatever else is wrong with a file makes one row with its code and message, and no
file disturbs another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.errors import JSON_INVALID, LEDGER_INVALID, EvidenceError
from evidentia.operators.report import ERROR, ITEM
from evidentia.sources import strict_json
from evidentia.sources.catalog import parse_catalog
from evidentia.sources.reports import MAX_ITEMS, validate_events, validate_report
from evidentia.sources.snapshots import changed, snapshot
from evidentia.workers import ready

REFUSED = "error_code string, error_message string"
EVENT = "struct<sequence:int,action:string,item_number:int,disposition:string,stage:string,at:string,previous_event_digest:string,digest:string>"
REPORTS = f"report_digest string, schema_version string, document_name string, document_sha256 string, as_of string, catalog_sha256 string, items array<{ITEM}>, collection_errors array<{ERROR}>"
LEDGERS = f"report_digest string, document_sha256 string, catalog_sha256 string, as_of string, most_item int, events array<{EVENT}>"
CATALOGS = (
    "catalog_sha256 string, "
    "versions array<struct<record_seq:int,version_seq:int,record_id:string,official_source:string,retrieved_at:string,effective_from:date,effective_to:date,title:string>>, "
    "provisions array<struct<record_seq:int,version_seq:int,provision_seq:int,canonical_id:string,label:string>>"
)
#: Bytes of content after which rows are sent on.
SEND = 16 * 1024 * 1024


def read_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def strict_object(data: bytes) -> dict:
    """A bounded strict JSON object, or the refusal of one."""
    bad = EvidenceError(*JSON_INVALID)
    if len(data) > strict_json.MAX_BYTES:
        raise bad
    try:
        value = strict_json.parse(data)
        strict_json.check_bounds(value)
    except (ValueError, RecursionError):
        raise bad from None
    if not isinstance(value, dict):
        raise bad
    return value


def report_row(data: bytes) -> dict[str, Any]:
    report = validate_report(strict_object(data))
    return report | {"report_digest": strict_json.digest(report)}


def ledger_row(data: bytes) -> dict[str, Any]:
    ledger = validate_events(strict_object(data))
    most = max((e["item_number"] or 0 for e in ledger["events"]), default=0)
    if most > MAX_ITEMS:
        raise EvidenceError(*LEDGER_INVALID)
    return {k: v for k, v in ledger.items() if k != "schema"} | {"most_item": most}


def catalog_row(data: bytes) -> dict[str, Any]:
    versions, provisions = parse_catalog(data)
    named = lambda names, rows: [dict(zip(names.split(), r, strict=True)) for r in rows]
    return {
        "catalog_sha256": hashlib.sha256(data).hexdigest(),
        "versions": named("record_seq version_seq record_id official_source retrieved_at effective_from effective_to title", versions),
        "provisions": named("record_seq version_seq provision_seq canonical_id label", provisions),
    }


def validated(files: DataFrame, row_of: Callable[[bytes], dict[str, Any]], columns: str, too_large: tuple[str, str] | None = None, max_bytes: int = strict_json.MAX_BYTES) -> DataFrame:
    """(path, columns..., error_code, error_message) of files; null content is an empty file.

    With ``too_large``, the refusal of files beyond ``max_bytes``, a frame that has ``length`` reads no content of those.
    """
    schema = T.StructType.fromDDL(f"path string, {columns}, {REFUSED}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py() or b""
                try:
                    made = row_of(data)
                except EvidenceError as e:
                    made = {"error_code": e.code, "error_message": e.message}
                rows.append({"path": batch.column(0)[i].as_py(), **made})
                size += len(data)
                if size >= SEND:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ready(files.sparkSession)
    if too_large is None or "length" not in files.columns:
        return files.select("path", "content").mapInArrow(run, schema)
    read = files.where(F.col("length") <= max_bytes).select("path", "content").mapInArrow(run, schema)
    told = {"path": F.col("path"), "error_code": F.lit(too_large[0]), "error_message": F.lit(too_large[1])}
    unread = files.where(F.col("length") > max_bytes).select(*(told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    return read.unionByName(unread)


#: What becomes of files that are too large, or that change while they are read.
TOO_LARGE = JSON_INVALID


def reports(files: DataFrame) -> DataFrame:
    """Reports with their canonical digest, or why a file is none."""
    return validated(files, report_row, REPORTS, TOO_LARGE)


def ledgers(files: DataFrame) -> DataFrame:
    """Ledgers whose events are coherent and chained, with the largest item number they name, or why a file is none.

    Whether a ledger belongs to a report is for ``operators.binding`` to say.
    """
    return validated(files, ledger_row, LEDGERS, TOO_LARGE)


def catalogs(files: DataFrame) -> DataFrame:
    """Catalogs as versions and provisions, or why a file is none; a catalog has no size bound."""
    return validated(files, catalog_row, CATALOGS)


def read_stable(spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame], output: str, pattern: str = "*.json") -> DataFrame:
    """What ``read`` (reports, ledgers, catalogs) makes of the files below a folder, where those that change meanwhile are refused.

    Lengths and times are taken before the files are read and once all are; ``output`` must be free and seen by all machines.
    """
    snapshot(spark, folder, pattern).write.parquet(f"{output}/before")
    read(read_files(spark, folder, pattern)).write.parquet(f"{output}/read")
    rows = spark.read.parquet(f"{output}/read")
    gone = changed(spark.read.parquet(f"{output}/before"), snapshot(spark, folder, pattern)).withColumn("changed", F.lit(True))
    told = rows.join(gone, "path", "left")
    refusal = dict(zip(("error_code", "error_message"), TOO_LARGE, strict=True))
    columns = [F.col(c) if c == "path" else F.when(F.col("changed"), F.lit(refusal.get(c))).otherwise(F.col(c)).alias(c) for c in rows.columns]
    told.select(*columns).write.parquet(f"{output}/stable")
    return spark.read.parquet(f"{output}/stable")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("error_code IS NULL").drop("error_code", "error_message")


def refused(rows: DataFrame) -> DataFrame:
    return rows.where("error_code IS NOT NULL").select("path", "error_code", "error_message")


def items(reports: DataFrame) -> DataFrame:
    """The items of accepted reports: (path, item_number, locator, title, provision, status, reason_code, evidence)."""
    each = reports.select("path", F.posexplode("items").alias("at", "i"))
    return each.select("path", (F.col("at") + 1).alias("item_number"), "i.locator", "i.reference.title", "i.reference.provision", "i.status", "i.reason_code", "i.evidence")


def events(ledgers: DataFrame) -> DataFrame:
    """The events of accepted ledgers, the path as ``ledger``."""
    return ledgers.select(F.col("path").alias("ledger"), F.inline("events"))


def versions(catalogs: DataFrame, name: str = "catalog") -> DataFrame:
    return catalogs.select(F.col("path").alias(name), F.inline("versions"))


def provisions(catalogs: DataFrame, name: str = "catalog") -> DataFrame:
    return catalogs.select(F.col("path").alias(name), F.inline("provisions"))
