"""Strict validation of reports and ledgers that come as JSON, and their item and event tables."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evidentia.errors import LEDGER_INVALID, EvidenceError
from evidentia.functions.checks import DISPOSITIONS, STAGES, STATUSES
from evidentia.operators.resolve import EVIDENCE
from evidentia.sources import strict_json
from evidentia.sources.catalog import TIMESTAMP, strict_day

MAX_ITEMS, MAX_EVENTS = 10_000, 50_000
LEDGER_SCHEMA, COMPARISON_SCHEMA = "citation-review/1", "citation-comparison/1"
SHA = re.compile(r"[0-9a-f]{64}")
UTC = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z", re.ASCII)
EVENT_KEYS = {"sequence", "action", "item_number", "disposition", "stage", "at", "previous_event_digest", "digest"}


class _Bad(ValueError):
    pass


def _need(ok: bool) -> None:
    if not ok:
        raise _Bad


def _keys(value: Any, keys: str) -> dict:
    _need(isinstance(value, dict) and set(value) == set(keys.split()))
    return value


def _text(value: Any, null: bool = False) -> None:
    _need((null and value is None) or (isinstance(value, str) and bool(value.strip())))


def _stamp(value: Any) -> None:
    _need(isinstance(value, str) and TIMESTAMP.fullmatch(value) is not None)
    datetime.fromisoformat(re.sub(r"\.\d+", "", value).replace("Z", "+00:00"))


def _evidence(e: Any) -> None:
    _keys(e, "record_id official_source retrieved_at as_of matched_effective_from matched_effective_to matched_title matched_provision version_transition")
    _text(e["record_id"])
    _text(e["official_source"])
    _stamp(e["retrieved_at"])
    strict_day(e["as_of"])
    strict_day(e["matched_effective_from"])
    if e["matched_effective_to"] is not None:
        strict_day(e["matched_effective_to"])
    _text(e["matched_title"])
    _text(e["matched_provision"], null=True)
    if (t := e["version_transition"]) is not None:
        _keys(t, "effective_from title provision")
        strict_day(t["effective_from"])
        _text(t["title"])
        _text(t["provision"], null=True)


def validate_report(report: Any) -> dict:
    """The report itself if it is a closed-world report of version "1" with at most MAX_ITEMS items."""
    try:
        _keys(report, "schema_version document_name document_sha256 as_of catalog_sha256 items collection_errors")
        _need(report["schema_version"] == "1")
        _text(report["document_name"])
        for k in ("document_sha256", "catalog_sha256"):
            _need(isinstance(report[k], str) and SHA.fullmatch(report[k]) is not None)
        strict_day(report["as_of"])
        _need(isinstance(report["items"], list) and len(report["items"]) <= MAX_ITEMS and isinstance(report["collection_errors"], list))
        for item in report["items"]:
            _keys(item, "locator reference status reason_code evidence")
            _text(item["locator"])
            _keys(item["reference"], "title provision")
            _text(item["reference"]["title"], null=True)
            _text(item["reference"]["provision"], null=True)
            _need(item["status"] in STATUSES)
            _text(item["reason_code"])
            _need(isinstance(item["evidence"], list))
            for e in item["evidence"]:
                _evidence(e)
        for e in report["collection_errors"]:
            _keys(e, "code stage fatal locator message")
            _text(e["code"])
            _need(e["stage"] in ("parse", "extract", "resolve") and isinstance(e["fatal"], bool))
            _text(e["locator"], null=True)
            _text(e["message"])
    except (ValueError, TypeError):
        raise EvidenceError("REVIEW_REPORT_INVALID", "Report is not valid.") from None
    return report


def event_time(value: Any) -> datetime:
    _need(isinstance(value, str) and UTC.fullmatch(value) is not None)
    return datetime.fromisoformat(value[:-1]).replace(tzinfo=timezone.utc)


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def validate_events(ledger: Any) -> dict:
    """The ledger itself if it has a ledger's keys and its events are coherent and chained, whatever report it belongs to."""
    try:
        _keys(ledger, "schema report_digest document_sha256 catalog_sha256 as_of events")
        _need(ledger["schema"] == LEDGER_SCHEMA and all(isinstance(ledger[k], str) for k in ("report_digest", "document_sha256", "catalog_sha256", "as_of")))
        events = ledger["events"]
        _need(isinstance(events, list) and len(events) <= MAX_EVENTS)
        last = None
        for n, e in enumerate(events, 1):
            _need(isinstance(e, dict) and set(e) == EVENT_KEYS and _whole(e["sequence"]) and e["sequence"] == n)
            if e["action"] == "decide":
                _need(_whole(e["item_number"]) and e["item_number"] >= 1 and e["disposition"] in DISPOSITIONS and e["stage"] is None)
            else:
                _need(e["action"] in ("start", "finish") and e["stage"] in STAGES and e["item_number"] is None and e["disposition"] is None)
            event_time(e["at"])
            _need(e["previous_event_digest"] == last and e["digest"] == strict_json.digest({k: v for k, v in e.items() if k != "digest"}))
            last = e["digest"]
    except (ValueError, TypeError):
        raise EvidenceError(*LEDGER_INVALID) from None
    return ledger


def validate_ledger(ledger: Any, report: dict) -> dict:
    """The ledger itself if it belongs to the report and its chain is whole."""
    validate_events(ledger)
    bound = {"report_digest": strict_json.digest(report)} | {k: report[k] for k in ("document_sha256", "catalog_sha256", "as_of")}
    most = max((e["item_number"] or 0 for e in ledger["events"]), default=0)
    if any(ledger[k] != v for k, v in bound.items()) or most > len(report["items"]):
        raise EvidenceError(*LEDGER_INVALID)
    return ledger


def item_table(spark: SparkSession, report: dict, pair: int = 0) -> DataFrame:
    rows = [(pair, n, i["locator"], i["reference"]["title"], i["reference"]["provision"], i["status"], i["reason_code"], i["evidence"]) for n, i in enumerate(report["items"], 1)]
    return spark.createDataFrame(rows, f"pair int, item_number int, locator string, title string, provision string, status string, reason_code string, evidence {EVIDENCE}")


def event_table(spark: SparkSession, ledger: dict, key: int = 0) -> DataFrame:
    names = ["sequence", "action", "item_number", "disposition", "stage", "at", "previous_event_digest", "digest"]
    rows = [(key, *(e[n] for n in names)) for e in ledger["events"]]
    return spark.createDataFrame(rows, "ledger int, sequence int, action string, item_number int, disposition string, stage string, at string, previous_event_digest string, digest string")
