"""Evidence reports: item tables, nested reports and their JSON, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.resolve import EVIDENCE

ITEM = f"struct<locator:string,reference:struct<title:string,provision:string>,status:string,reason_code:string,evidence:{EVIDENCE}>"
ERROR = "struct<code:string,stage:string,fatal:boolean,locator:string,message:string>"


def item() -> Column:
    return F.struct("locator", F.struct("title", "provision").alias("reference"), "status", "reason_code", "evidence")


def reports(documents: DataFrame, items: DataFrame, errors: DataFrame, as_of: str, catalog_sha256: str) -> DataFrame:
    """One report row per document (path, document_sha256).

    items: (path, item_number, locator, title, provision, status, reason_code, evidence); errors: (path, code, stage, locator,
    message).  A document with an error has that error and no items, whatever was found before.
    """
    faults = errors.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("code", "stage", F.lit(True).alias("fatal"), "locator", "message"))).alias("collection_errors"))
    kept = items.join(faults, "path", "left_anti").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_number", item().alias("item")))), lambda x: x["item"]).alias("items"))
    return shaped(documents.select("path", "document_sha256").join(kept, "path", "left").join(faults, "path", "left"), as_of, catalog_sha256)


def shaped(documents: DataFrame, as_of: str, catalog_sha256: str | Column) -> DataFrame:
    """Report rows of (path, document_sha256, items, collection_errors), where missing lists are empty; one catalog, or a column of them."""
    return documents.select(
        "path",
        F.lit("1").alias("schema_version"),
        F.concat(F.lit("document-"), F.substring("document_sha256", 1, 12), F.lit(".hwpx")).alias("document_name"),
        "document_sha256",
        F.lit(as_of).alias("as_of"),
        (F.lit(catalog_sha256) if isinstance(catalog_sha256, str) else catalog_sha256).alias("catalog_sha256"),
        F.coalesce("items", F.array().cast(f"array<{ITEM}>")).alias("items"),
        F.coalesce("collection_errors", F.array().cast(f"array<{ERROR}>")).alias("collection_errors"),
    )


def as_json(report: DataFrame) -> DataFrame:
    """(path, json): nulls are written out."""
    return report.select("path", F.to_json(F.struct(*(c for c in report.columns if c != "path")), {"ignoreNullFields": "false"}).alias("json"))
