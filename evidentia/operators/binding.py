"""Which report a ledger belongs to, and the canonical digest of reports as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.errors import LEDGER_INVALID

BOUND = ["report_digest", "document_sha256", "catalog_sha256", "as_of"]
#: Control characters whose number has a letter, which the canonical form writes small.
LETTERED = [c for c in range(0x20) if chr(c) not in "\b\t\n\f\r" and c % 16 >= 10]


def _sorted(c: Column, *keys: str) -> Column:
    return F.struct(*(c[k].alias(k) for k in sorted(keys)))


def canonical_report() -> Column:
    """The canonical JSON of a report row (its columns by name): sorted keys, no blanks, nulls written out, text as it is."""
    change = lambda t: F.when(t.isNotNull(), _sorted(t, "effective_from", "title", "provision"))

    def proof(e: Column) -> Column:
        keys = ["record_id", "official_source", "retrieved_at", "as_of", "matched_effective_from", "matched_effective_to", "matched_title", "matched_provision", "version_transition"]
        return F.struct(*((change(e[k]) if k == "version_transition" else e[k]).alias(k) for k in sorted(keys)))

    item = lambda i: F.struct(F.transform(i["evidence"], proof).alias("evidence"), i["locator"].alias("locator"), i["reason_code"].alias("reason_code"), _sorted(i["reference"], "title", "provision").alias("reference"), i["status"].alias("status"))
    fault = lambda e: _sorted(e, "code", "stage", "fatal", "locator", "message")
    whole = F.struct("as_of", "catalog_sha256", F.transform("collection_errors", fault).alias("collection_errors"), "document_name", "document_sha256", F.transform("items", item).alias("items"), "schema_version")
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    for c in LETTERED:  # an even number of backslashes before it is text, not an escape
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{c:02X}", rf"$1\\u00{c:02x}")
    return text


def report_digest() -> Column:
    return F.sha2(canonical_report().cast("binary"), 256)


def bind(ledgers: DataFrame, reports: DataFrame) -> DataFrame:
    """Ledgers (``bulk.ledgers``) with the report they belong to, or why there is none.

    Returns (path, report_path, n_items, events, error_code, error_message).  A ledger belongs to a report whose digest,
    document, catalog and day it names and whose items are as many as its events need; of equal reports the first path counts.
    A ledger that was refused before stays so.  Ledgers name their report by a digest, so no key is hot but that of a report that
    many ledgers share, whose single row the planner copies to a split partition.
    """
    known = reports.where("error_code IS NULL").groupBy(*BOUND).agg(F.min("path").alias("report_path"), F.max(F.size("items")).alias("n_items"))
    joined = ledgers.join(known, BOUND, "left")
    fits = F.col("error_code").isNull() & F.col("report_path").isNotNull() & (F.col("most_item") <= F.col("n_items"))
    told = [F.when(~F.coalesce(fits, F.lit(False)), F.coalesce(c, F.lit(v))).alias(c) for c, v in zip(("error_code", "error_message"), LEDGER_INVALID, strict=True)]
    only = lambda c: F.when(fits, F.col(c)).alias(c)
    return joined.select("path", only("report_path"), only("n_items"), only("events"), *told)
