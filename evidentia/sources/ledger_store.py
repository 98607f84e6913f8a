"""A ledger file: one writer at a time by a lock file, compare and swap, atomic replacement."""

from __future__ import annotations

import contextlib
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

from evidentia.errors import CONFLICT, EvidenceError
from evidentia.sources import strict_json
from evidentia.sources.reports import LEDGER_SCHEMA, MAX_EVENTS, validate_ledger, validate_report


def new_ledger(report: dict) -> dict:
    return {"schema": LEDGER_SCHEMA, "report_digest": strict_json.digest(report), **{k: report[k] for k in ("document_sha256", "catalog_sha256", "as_of")}, "events": []}


def append_event(ledger: dict, report: dict, action: str, item_number: int | None = None, disposition: str | None = None, stage: str | None = None, at: str | None = None) -> dict:
    """A longer ledger; the event chains to the last and the whole is validated again."""
    events = ledger["events"]
    if len(events) >= MAX_EVENTS:
        raise EvidenceError("REVIEW_LEDGER_INVALID", "Review ledger is full.")
    event = {"sequence": len(events) + 1, "action": action, "item_number": item_number, "disposition": disposition, "stage": stage, "at": at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "previous_event_digest": events[-1]["digest"] if events else None}
    return validate_ledger(ledger | {"events": [*events, event | {"digest": strict_json.digest(event)}]}, report)


@contextlib.contextmanager
def locked(path: Path):
    """Hold ``path.lock``; one that is there already is someone else's and is never removed."""
    lock, mine = path.with_name(path.name + ".lock"), uuid.uuid4().hex.encode()
    try:
        with lock.open("xb") as f:
            f.write(mine)
    except FileExistsError:
        raise EvidenceError("REVIEW_BUSY", "Another review update holds the lock.") from None
    except OSError:
        raise EvidenceError("REVIEW_WRITE_FAILED", "Lock could not be written.", 1) from None
    try:
        yield
    finally:
        with contextlib.suppress(OSError):
            if lock.read_bytes() == mine:
                lock.unlink()


def update_ledger(path: str | Path, report_path: str | Path, **event) -> dict:
    """Append one event to the ledger file of a report, creating the file at first; nothing is lost to another writer."""
    path, report_path = Path(path), Path(report_path)
    if path.absolute() == report_path.absolute():
        raise EvidenceError("REVIEW_PATH_INVALID", "Ledger and report must differ.")
    strict_json.safe_path(path, existing=False)
    with locked(path):
        report = validate_report(strict_json.read_object(report_path))
        there = strict_json.safe_path(path, existing=False) is not None
        before = strict_json.read_object(path) if there else None
        ledger = validate_ledger(before, report) if there else new_ledger(report)
        after = append_event(ledger, report, **event)
        data = strict_json.canonical(after)
        if len(data) > strict_json.MAX_BYTES:
            raise EvidenceError("REVIEW_LEDGER_INVALID", "Review ledger is too large.")
        temp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        try:
            with temp.open("xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            if temp.read_bytes() != data:
                raise EvidenceError("REVIEW_WRITE_FAILED", "Ledger could not be written.", 1)
            if not there:
                try:
                    os.link(temp, path)
                except FileExistsError:
                    raise EvidenceError(*CONFLICT) from None
            else:
                try:
                    same = strict_json.read_object(path) == before
                except EvidenceError:  # it vanished, or is no ledger any more
                    same = False
                if not same:
                    raise EvidenceError(*CONFLICT)
                os.replace(temp, path)
        except OSError:
            raise EvidenceError("REVIEW_WRITE_FAILED", "Ledger could not be written.", 1) from None
        finally:
            with contextlib.suppress(FileNotFoundError):
                temp.unlink()
    return after
