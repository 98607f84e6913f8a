"""Command line: scan (the default), --demo, review, compare, render."""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from datetime import date
from pathlib import Path

import evidentia
from evidentia.errors import EvidenceError
from evidentia.functions.checks import ACTIONS, DISPOSITIONS, STAGES
from evidentia.sources import strict_json
from evidentia.sources.catalog import strict_day


class Parser(argparse.ArgumentParser):
    """Refuses abbreviations, repeated options and whatever else does not parse, with one code."""

    def __init__(self, name: str, *options: str):
        super().__init__(name, allow_abbrev=False)
        for o in options:
            self.add_argument(o.rstrip("!"), required=o.endswith("!"))

    def error(self, message: str):
        raise EvidenceError("ARGUMENT_ERROR", message)

    def parse_args(self, args):
        flags = [a.split("=", 1)[0] for a in args if a.startswith("--")]
        if len(set(flags)) < len(flags):
            self.error("an option is repeated")
        return super().parse_args(args)


def pretty(value: dict) -> bytes:
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()


def write_atomic(path: Path, data: bytes) -> None:
    """Replace a file in one step; nothing half-written stays behind."""
    temp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        with temp.open("xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except OSError:
        raise EvidenceError("REVIEW_OUTPUT_FAILED", "Output could not be written.", 1) from None
    finally:
        temp.unlink(missing_ok=True)


def day(text: str) -> date:
    try:
        return strict_day(text)
    except ValueError:
        raise EvidenceError("ARGUMENT_ERROR", "as-of must be a date YYYY-MM-DD.") from None


def _scan(args: list[str]) -> int:
    a = Parser("evidentia", "--document", "--as-of", "--catalog", "--output", "--demo").parse_args(args)
    if a.demo is not None:
        from evidentia.plans.demo import create_demo

        if a.document or a.as_of or a.catalog or a.output:
            raise EvidenceError("ARGUMENT_ERROR", "--demo stands alone.")
        sys.stdout.buffer.write(pretty(create_demo(a.demo)))
        return 0
    if a.document is None or a.as_of is None or a.catalog is None:
        raise EvidenceError("ARGUMENT_ERROR", "--document, --as-of and --catalog are needed.")
    as_of = day(a.as_of)
    if a.output and Path(a.output).resolve() in (Path(a.document).resolve(), Path(a.catalog).resolve()):
        raise EvidenceError("ARGUMENT_ERROR", "Output must differ from the inputs.")
    report = evidentia.scan_document(a.document, as_of, a.catalog)
    if a.output:
        write_atomic(Path(a.output), pretty(report))
    else:
        sys.stdout.buffer.write(pretty(report))
    return 1 if report["collection_errors"] else 0


def _review(args: list[str]) -> int:
    from evidentia.sources.ledger_store import update_ledger

    p = Parser("evidentia review", "--report!", "--ledger!")
    p.add_argument("--action", required=True, choices=ACTIONS)
    p.add_argument("--item", type=int)
    p.add_argument("--disposition", choices=DISPOSITIONS)
    p.add_argument("--stage", choices=STAGES)
    a = p.parse_args(args)
    given = [a.item is not None, a.disposition is not None, a.stage is not None]
    if given != ([True, True, False] if a.action == "decide" else [False, False, True]):
        raise EvidenceError("ARGUMENT_ERROR", "decide takes an item and a disposition, start and finish a stage.")
    update_ledger(a.ledger, a.report, action=a.action, item_number=a.item, disposition=a.disposition, stage=a.stage)
    return 0


def _compare(args: list[str]) -> int:
    p = Parser("evidentia compare", "--before!", "--after!")
    p.add_argument("--related-versions", action="store_true")
    a = p.parse_args(args)
    before, after = (strict_json.read_object(Path(x)) for x in (a.before, a.after))
    sys.stdout.buffer.write(pretty(evidentia.compare_reports(before, after, a.related_versions)))
    return 0


def _render(args: list[str]) -> int:
    a = Parser("evidentia render", "--report!", "--ledger", "--output!").parse_args(args)
    inputs = [Path(x) for x in (a.report, a.ledger) if x is not None]
    page = evidentia.render_review(*(strict_json.read_object(p) for p in inputs))
    strict_json.write_new(Path(a.output), page.encode(), inputs)
    return 0


def main(args: list[str] | None = None) -> int:
    """0: done; 1: a report with collection errors, or a failure; 2: refused.  Failures print their code alone."""
    args = sys.argv[1:] if args is None else args
    commands = {"review": (_review, "REVIEW_WRITE_FAILED"), "compare": (_compare, "REVIEW_COMPARE_FAILED"), "render": (_render, "REVIEW_OUTPUT_FAILED")}
    run, unforeseen = commands.get(args[0] if args else "", (None, "UNEXPECTED_ERROR"))
    try:
        return run(args[1:]) if run else _scan(args)
    except EvidenceError as e:
        print(e.code, file=sys.stderr)
        return e.status
    except Exception:  # the one place that turns what nobody foresaw into a code
        print(unforeseen, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
