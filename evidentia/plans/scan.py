"""The scan: documents and a dated catalog to evidence reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.errors import CATALOG_NOT_FOUND, COLLECTION, STAGE_OF, EvidenceError
from evidentia.operators import extract, report, resolve
from evidentia.sources import bulk, hwpx
from evidentia.sources.catalog import Catalog, load_catalog
from evidentia.sources.snapshots import changed, hashes, snapshot
from evidentia.workers import checkpointed


KEYS = ["path", "document_sha256", "section_rank", "ordinal", "locator", "error_code", "error_locator", "error_message"]


def _budgets(options: dict) -> dict:
    """Takes the work budgets out of the options."""
    return {k: options.pop(k) for k in list(options) if k.startswith(("matches_", "candidates_"))}


def _grouped(found: DataFrame, budgets: dict, answered: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """(path, document_sha256, more..., items, collection_errors) of nodes with candidates, dealt by path once.

    Budgets are summed and items numbered there; a document beyond a budget, or with a parse error, has that error alone.
    """
    keys = [*KEYS, *more]
    document = Window.partitionBy("path")
    counted = found.withColumns({"void": extract.beyond_budget(lambda c: c.over(document), **budgets)})
    free = F.when(~F.col("void") & F.col("error_code").isNull(), F.col("candidates"))
    rows = counted.select(*keys, "void", F.explode_outer(free).alias("c")).select(*keys, "void", "c.start", "c.title", "c.provision")
    told = answered(rows.withColumn("item_number", F.row_number().over(document.orderBy(F.col("start").isNull(), "section_rank", "ordinal", "start"))))
    code, none = "REFERENCE_LIMIT_EXCEEDED", F.lit(None).cast("string")
    fault = lambda *c: F.struct(*(x.alias(n) for n, x in zip(("code", "stage", "fatal", "locator", "message"), c, strict=True)))
    parse = F.when(F.col("error_code").isNotNull(), fault(F.col("error_code"), F.lit("parse"), F.lit(True), F.col("error_locator"), F.col("error_message")))
    limited = F.when(F.col("void"), fault(F.lit(code), F.lit(STAGE_OF[code]), F.lit(True), none, F.lit(COLLECTION[code])))
    items = F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("item_number", report.item().alias("item")))))
    return told.groupBy("path", "document_sha256", *more).agg(F.transform(items, lambda x: x["item"]).alias("items"), F.sort_array(F.collect_set(F.coalesce(parse, limited))).alias("collection_errors"))


def scan_documents(spark: SparkSession, files: DataFrame, catalog: Catalog, as_of: str, limits: hwpx.Limits = hwpx.Limits(), **options) -> DataFrame:
    """One report row per archive of a ``binaryFile`` frame; parse and budget errors void a document as a whole.

    An archive is read and parsed once: its nodes, or its error, are rows that are dealt by path once, where budgets are summed,
    items numbered and the report put together.
    """
    budgets = _budgets(options)
    found = extract.mentions(hwpx.parse_documents(files, limits), extract.Dictionary.of(catalog.titles), KEYS, **options)
    grouped = _grouped(found, budgets, lambda rows: resolve.attach(rows, catalog.versions, catalog.provisions, as_of))
    return report.shaped(grouped, as_of, catalog.sha256)


def scan_by_catalog(spark: SparkSession, files: DataFrame, catalogs: DataFrame, as_of: str, limits: hwpx.Limits = hwpx.Limits(), **options) -> tuple[DataFrame, DataFrame]:
    """(reports, refused) of archives (path, content, catalog) against the catalogs (``bulk.catalogs``) that each names by its path.

    Any number of catalogs and documents go through one plan: catalogs are parsed once, nodes and dictionaries meet by catalog,
    and answers by catalog, title and provision.  ``refused`` has (path, error_code, error_message) of documents whose catalog
    was refused, or is not there; those have no report.  Paths of either table must not repeat.
    """
    budgets = _budgets(options)
    read = checkpointed(catalogs)
    kept = bulk.accepted(read)
    named = files.select("path", F.col("catalog").alias("catalog"))
    told = named.join(read.select(F.col("path").alias("catalog"), F.lit(True).alias("there"), "error_code", "error_message"), "catalog", "left")
    missing = [F.when(F.col("there").isNull(), v).otherwise(F.col(c)).alias(c) for c, v in zip(("error_code", "error_message"), CATALOG_NOT_FOUND, strict=True)]
    refused = told.where("there IS NULL OR error_code IS NOT NULL").select("path", *missing)
    known = kept.select(F.col("path").alias("catalog"), "catalog_sha256")
    nodes = hwpx.parse_documents(files, limits).join(named.join(known, "catalog"), "path")
    v, p = bulk.versions(kept), bulk.provisions(kept)
    more = ("catalog", "catalog_sha256")
    found = extract.catalog_mentions(nodes, v, [*KEYS, *more], **options)
    grouped = _grouped(found, budgets, lambda rows: resolve.attach(rows, v, p, as_of, by=("catalog",)), *more)
    return report.shaped(grouped, as_of, F.col("catalog_sha256")), refused


def without_changed(reports: DataFrame, paths: DataFrame) -> DataFrame:
    """Reports, where those of the given paths have no items but one error that tells that the source changed."""
    code = "SOURCE_CHANGED_DURING_SCAN"
    fault = F.array(F.struct(F.lit(code).alias("code"), F.lit("parse").alias("stage"), F.lit(True).alias("fatal"), F.lit(None).cast("string").alias("locator"), F.lit(COLLECTION[code]).alias("message")))
    told = reports.join(paths.select("path").distinct().withColumn("source_changed", F.lit(True)), "path", "left")
    void = F.coalesce("source_changed", F.lit(False))
    columns = {"items": F.when(void, F.array().cast(reports.schema["items"].dataType)).otherwise(F.col("items")), "collection_errors": F.when(void, fault.cast(reports.schema["collection_errors"].dataType)).otherwise(F.col("collection_errors"))}
    return told.withColumns(columns).select(*reports.columns)


def scan_whole_folder(spark: SparkSession, folder: str, catalog: Catalog, as_of: str, output: str, rehash: bool = False, **options) -> DataFrame:
    """Scan a folder once, and void what changed meanwhile: the reports, also written below ``output``.

    Lengths and times are taken before and after; with ``rehash`` every file is read and hashed again as well, which finds
    changes that leave both alike.  ``output`` must be free and seen by all machines.
    """
    snapshot(spark, folder).write.parquet(f"{output}/before")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hwpx").option("recursiveFileLookup", "true").load(folder)
    scan_documents(spark, files, catalog, as_of, **options).write.parquet(f"{output}/scanned")
    scanned = spark.read.parquet(f"{output}/scanned")
    gone = changed(spark.read.parquet(f"{output}/before"), snapshot(spark, folder))
    if rehash:
        other = scanned.join(hashes(spark, folder), "path", "left").where(F.col("document_sha256").isNotNull() & ~F.col("document_sha256").eqNullSafe(F.col("sha256")))
        gone = gone.unionByName(other.select("path"))
    without_changed(scanned, gone).write.parquet(f"{output}/reports")
    return spark.read.parquet(f"{output}/reports")


def strict_as_of(value) -> str:
    """The review date: a date, not a time stamp."""
    if isinstance(value, datetime) or not isinstance(value, date):
        raise EvidenceError("AS_OF_TYPE_INVALID", "as_of must be a date.")
    return value.isoformat()


def scan_document(spark: SparkSession, path: str | Path, as_of: date, catalog: str | Path) -> dict:
    """The report of one document as a dict; the document is hashed again once all is computed, and void if it changed."""
    path = Path(path)
    if not path.is_file():
        raise EvidenceError("DOCUMENT_NOT_FOUND", "Document was not found.")
    try:
        before = hashlib.sha256(path.read_bytes()).hexdigest()
    except OSError:
        raise EvidenceError("DOCUMENT_NOT_READABLE", "Document cannot be read.") from None
    if not Path(catalog).is_file():
        raise EvidenceError(*CATALOG_NOT_FOUND)
    strict_as_of(as_of)
    loaded = load_catalog(spark, catalog)
    files = spark.read.format("binaryFile").load(path.absolute().as_uri())
    out = json.loads(report.as_json(scan_documents(spark, files, loaded, as_of.isoformat())).first()["json"])
    try:
        after = hashlib.sha256(path.read_bytes()).hexdigest()
    except OSError:
        after = None
    if {before, after, out["document_sha256"]} != {before}:
        code = "SOURCE_CHANGED_DURING_SCAN"
        out |= {"document_sha256": before, "document_name": f"document-{before[:12]}.hwpx", "items": [], "collection_errors": [{"code": code, "stage": "parse", "fatal": True, "locator": None, "message": COLLECTION[code]}]}
    return out
