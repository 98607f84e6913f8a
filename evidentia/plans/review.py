"""Reports and ledgers of single files: comparison, summary and page."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.operators import compare, ledger
from evidentia.plans import render
from evidentia.sources.ledger_store import new_ledger
from evidentia.sources.reports import COMPARISON_SCHEMA, event_table, item_table, validate_ledger, validate_report
from evidentia.sources.strict_json import digest


def compare_reports(spark: SparkSession, before: dict, after: dict, related: bool = False) -> dict:
    """The comparison of two reports as a dict: changes by kind and number, unresolved items, and no transfer of decisions."""
    validate_report(before)
    validate_report(after)
    head = lambda r: spark.createDataFrame([(0, r["document_sha256"], r["catalog_sha256"], r["as_of"], len(r["items"]), len(r["collection_errors"]))], "pair int, document_sha256 string, catalog_sha256 string, as_of string, n_items int, n_errors int")
    h = compare.headers(head(before), head(after), related).first()
    metadata = [{"type": k, "before_item_number": None, "after_item_number": None, "before": before["catalog_sha256" if k == "catalog" else "as_of"], "after": after["catalog_sha256" if k == "catalog" else "as_of"]} for k in h["metadata"]]
    out = {"schema": COMPARISON_SCHEMA, "comparable": h["comparable"], "relationship": h["relationship"], "changes": [], "unresolved": [], "decision_transfer": False}
    if not h["comparable"]:
        return out | {"changes": metadata, "unresolved": [{"reason": h["reason"], "before_item_numbers": [], "after_item_numbers": []}]}
    old, new = item_table(spark, before), item_table(spark, after)
    changes = []
    if h["relationship"] == "same_document":
        found, unresolved = compare.same_document(old, new)
        for c in compare.in_order(found).orderBy("place").collect():
            b, a = (items[n - 1] if n else None for items, n in ((before["items"], c["before_item_number"]), (after["items"], c["after_item_number"])))
            if c["type"] == "status":
                b, a = ({k: x[k] for k in ("status", "reason_code")} for x in (b, a))
            elif c["type"] == "evidence":
                b, a = b["evidence"], a["evidence"]
            changes.append({"type": c["type"], "before_item_number": c["before_item_number"], "after_item_number": c["after_item_number"], "before": b, "after": a})
    else:
        unresolved = compare.related_versions(compare.united(old, new))
    order = (F.size("before_item_numbers") == 0, F.get("before_item_numbers", 0), F.get("after_item_numbers", 0))
    left = [{"reason": u["reason"], "before_item_numbers": list(u["before_item_numbers"]), "after_item_numbers": list(u["after_item_numbers"])} for u in unresolved.orderBy(*order).collect()]
    return out | {"changes": changes + metadata, "unresolved": left}


def review_summary(spark: SparkSession, book: dict, report: dict) -> dict:
    validate_ledger(book, validate_report(report))
    heads = spark.createDataFrame([(0, len(report["items"]))], "ledger int, n_items int")
    return ledger.summary(event_table(spark, book), heads).drop("ledger").first().asDict(recursive=True)


def render_review(spark: SparkSession, report: dict, book: dict | None = None) -> str:
    book = new_ledger(validate_report(report)) if book is None else book
    summary = review_summary(spark, book, report)
    heads = spark.createDataFrame(
        [(0, report["document_name"], report["as_of"], digest(report), len(report["items"]), summary["unreviewed_count"], summary["disposition_counts"], {k: v["seconds"] for k, v in summary["timing"].items()}, [(e["code"], e["stage"], e["message"]) for e in report["collection_errors"]])],
        render.HEADS,
    )
    return render.pages(item_table(spark, report), event_table(spark, book), heads).first()["html"]
