"""Dated-evidence analytics on Spark: titles in documents, resolved against a catalog as of a date."""

from evidentia.errors import EvidenceError

__all__ = ["EvidenceError", "compare_reports", "render_review", "review_summary", "scan_document"]


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("evidentia").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def scan_document(path, as_of, catalog, spark=None) -> dict:
    """The evidence report of one document as of a date."""
    from evidentia.plans import scan

    return scan.scan_document(spark or _session(), path, as_of, catalog)


def compare_reports(before: dict, after: dict, related_versions: bool = False, spark=None) -> dict:
    from evidentia.plans import review

    return review.compare_reports(spark or _session(), before, after, related_versions)


def review_summary(ledger: dict, report: dict, spark=None) -> dict:
    from evidentia.plans import review

    return review.review_summary(spark or _session(), ledger, report)


def render_review(report: dict, ledger: dict | None = None, spark=None) -> str:
    from evidentia.plans import review

    return review.render_review(spark or _session(), report, ledger)
