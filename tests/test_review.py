"""Reports, comparisons, ledgers, pages and the command line."""

import json

import pytest

import evidentia
from evidentia.__main__ import main
from evidentia.errors import EvidenceError
from evidentia.sources import ledger_store, strict_json
from evidentia.sources.reports import validate_ledger, validate_report


def item(title, provision="제1조", locator="Contents/section0.xml:t[1]", status="REVIEW", evidence=()):
    return {"locator": locator, "reference": {"title": title, "provision": provision}, "status": status, "reason_code": "CONFLICTING_EVIDENCE", "evidence": list(evidence)}


def report(*items, sha="a", **more):
    return {"schema_version": "1", "document_name": "document-x.hwpx", "document_sha256": sha * 64, "as_of": "2024-12-31", "catalog_sha256": "b" * 64, "items": list(items), "collection_errors": []} | more


def event(book, rep, action, at, **more):
    return ledger_store.append_event(book, rep, action, at=at, **more)


def test_compare_kinds_and_order(spark):
    before = report(item("A"), item("B"), item("C"))
    after = report(item("A", status="CURRENT"), item("D"), item("C"), as_of="2025-01-01")
    out = evidentia.compare_reports(before, after, spark=spark)
    assert [c["type"] for c in out["changes"]] == ["status", "removed", "added", "as_of"]
    assert out["comparable"] and not out["unresolved"] and out["decision_transfer"] is False
    assert out["changes"][1]["before"]["reference"]["title"] == "B" and out["changes"][2]["after_item_number"] == 2


def test_compare_moved_and_repeated(spark):
    out = evidentia.compare_reports(report(item("A"), item("B"), item("B")), report(item("B"), item("A"), item("B")), spark=spark)
    assert not out["changes"]
    assert [(u["reason"], u["before_item_numbers"], u["after_item_numbers"]) for u in out["unresolved"]] == [("candidate_identity_unconfirmed", [1], [2]), ("candidate_identity_unconfirmed", [2], [1])]


def test_compare_gates(spark):
    a, other = report(item("A")), report(item("A"), sha="c")
    error = {"code": "X", "stage": "parse", "fatal": True, "locator": None, "message": "m"}
    reason = lambda *x, **k: evidentia.compare_reports(*x, **k, spark=spark)["unresolved"][0]["reason"]
    assert reason(a, report(item("A"), collection_errors=[error])) == "collection_errors"
    assert reason(a, report()) == "empty_report_not_completion"
    assert reason(a, other) == "unrelated_documents"
    out = evidentia.compare_reports(a, other, related_versions=True, spark=spark)
    assert out["relationship"] == "related_versions" and out["unresolved"][0]["after_item_numbers"] == [1]


def test_ledger_decisions_and_timing(spark):
    rep = report(item("A"), item("B"))
    book = ledger_store.new_ledger(rep)
    for d, n in (("confirm", 1), ("reject", 1), ("defer", 2)):
        book = event(book, rep, "decide", "2025-01-01T00:00:00Z", item_number=n, disposition=d)
    for stage, steps in {"triage": [("start", 0), ("finish", 10)], "evidence": [("finish", 20)], "decision": [("start", 30), ("start", 31), ("finish", 32)]}.items():
        for action, s in steps:
            book = event(book, rep, action, f"2025-01-01T00:00:{s:02}Z", stage=stage)
    out = evidentia.review_summary(book, rep, spark=spark)
    assert out["latest_decisions"] == {"1": "reject", "2": "defer"} and out["unreviewed_count"] == 0
    assert out["disposition_counts"] == {"confirm": 0, "defer": 1, "investigate": 0, "reject": 1}
    assert out["timing"] == {"triage": {"seconds": 10.0, "status": "measured"}, "evidence": {"seconds": None, "status": "unknown"}, "decision": {"seconds": None, "status": "unknown"}}


def test_ledger_overlap_and_reversal(spark):
    rep = report(item("A"))
    book = ledger_store.new_ledger(rep)
    for action, s, stage in (("start", 0, "triage"), ("finish", 10, "triage"), ("start", 5, "evidence"), ("finish", 6, "evidence"), ("start", 40, "decision"), ("finish", 30, "decision")):
        book = event(book, rep, action, f"2025-01-01T00:00:{s:02}Z", stage=stage)
    assert {x["status"] for x in evidentia.review_summary(book, rep, spark=spark)["timing"].values()} == {"unknown"}


@pytest.mark.parametrize("bend", [lambda b: b["events"][0].update(digest="0" * 64), lambda b: b["events"][1].update(sequence=3), lambda b: b.update(as_of="2024-01-01"), lambda b: b["events"][0].update(item_number=True), lambda b: b["events"].pop(0)])
def test_broken_ledgers(bend):
    rep = report(item("A"), item("B"))
    book = ledger_store.new_ledger(rep)
    for n in (1, 2):
        book = event(book, rep, "decide", "2025-01-01T00:00:00Z", item_number=n, disposition="confirm")
    book = json.loads(json.dumps(book))
    bend(book)
    with pytest.raises(EvidenceError) as e:
        validate_ledger(book, rep)
    assert e.value.code == "REVIEW_LEDGER_INVALID"


def test_spark_and_driver_agree_on_digests(spark):
    from pyspark.sql import functions as F

    from evidentia.operators import ledger
    from evidentia.sources.reports import event_table

    rep = report(item("A"))
    book = ledger_store.new_ledger(rep)
    book = event(book, rep, "start", "2025-01-01T00:00:00.5Z", stage="triage")
    book = event(book, rep, "decide", "2025-01-01T00:00:01Z", item_number=1, disposition="investigate")
    table = event_table(spark, book)
    assert table.where(F.col("digest") != ledger.event_digest()).count() == 0
    assert ledger.validate(table, 1).first()["valid"]
    more = ledger.append(table, spark.createDataFrame([(0, "finish", None, None, "triage", "2025-01-01T00:00:02Z")], "ledger int, action string, item_number int, disposition string, stage string, at string"))
    assert more.count() == 3 and ledger.validate(more, 1).first()["valid"]
    assert not ledger.validate(table, 1, max_events=1).first()["valid"]


def test_whole_chains_against_a_plain_fold(spark):
    """Ledgers of up to 40 events in mixed order; any one bent digest makes its ledger invalid, the others stand."""
    import hashlib

    from pyspark.sql import functions as F

    from evidentia.operators import ledger

    rows = [(b, n, "decide", n % 3 + 1, "confirm", None, f"2025-01-01T00:00:{n:02}Z") for n in range(40, 0, -1) for b in range(4) if n <= 13 * b + 1]
    schema = "ledger long, sequence int, action string, item_number int, disposition string, stage string, at string"
    made = ledger.chain(spark.createDataFrame(rows, schema))
    got = {(r["ledger"], r["sequence"]): (r["previous_event_digest"], r["digest"]) for r in made.collect()}
    want, last = {}, {}
    for b, n, action, item_number, disposition, stage, at in sorted(rows):
        fields = {"action": action, "at": at, "disposition": disposition, "item_number": item_number, "previous_event_digest": last.get(b), "sequence": n, "stage": stage}
        digest = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        want[b, n], last[b] = (last.get(b), digest), digest
    assert got == want
    assert {r["ledger"]: (r["events"], r["valid"]) for r in ledger.validate(made, 3).collect()} == {b: (13 * b + 1, True) for b in range(4)}
    for b, n in ((1, 14), (2, 5), (3, 40)):
        bent = made.withColumn("digest", F.when((F.col("ledger") == b) & (F.col("sequence") == n), F.reverse("digest")).otherwise(F.col("digest")))
        assert {r["ledger"] for r in ledger.validate(bent, 3).collect() if not r["valid"]} == {b}


def test_strict_json_bounds(tmp_path):
    for text in ('{"a":1,"a":1}', '{"a":Infinity}', "[1]", '{"a":"\\ud800"}', '{"a":' * 33 + "1" + "}" * 33):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(EvidenceError) as e:
            strict_json.read_object(tmp_path / "x.json")
        assert e.value.code == "REVIEW_JSON_INVALID"
    with pytest.raises(ValueError):
        strict_json.check_bounds([0] * 200_000)
    strict_json.check_bounds([0] * 199_999)
    (tmp_path / "link").symlink_to(tmp_path / "x.json")
    with pytest.raises(EvidenceError):
        strict_json.read_object(tmp_path / "link")


def test_report_limits():
    validate_report(report(*[item("A")] * 10_000))
    for bad in (report(*[item("A")] * 10_001), report(item("A"), more=1), report(item(" ")), report(item("A", status="OTHER"))):
        with pytest.raises(EvidenceError):
            validate_report(bad)


def test_command_line(spark, tmp_path, capfdbinary):
    assert main(["--demo", str(tmp_path / "demo")]) == 0
    inputs = ["--document", str(tmp_path / "demo/synthetic-review.hwpx"), "--catalog", str(tmp_path / "demo/catalog.json")]
    assert main([*inputs, "--as-of", "2024-12-31", "--output", str(tmp_path / "r.json")]) == 0
    assert main([*inputs, "--as-of", "20241231"]) == 2
    files = ["--report", str(tmp_path / "r.json"), "--ledger", str(tmp_path / "l.json")]
    assert main(["review", *files, "--action", "decide", "--item", "1", "--disposition", "confirm"]) == 0
    assert main(["review", *files, "--action", "start", "--item", "1"]) == 2
    assert main(["render", *files, "--output", str(tmp_path / "p.html")]) == 0
    page = (tmp_path / "p.html").read_text()
    assert "<td>confirm</td>" in page and page.index("<td>REVIEW</td>") < page.index("<td>UNKNOWN</td>") < page.index("<td>CURRENT</td>")
    assert main(["render", *files, "--output", str(tmp_path / "p.html")]) == 2
    assert main(["compare", "--before", str(tmp_path / "r.json"), "--after", str(tmp_path / "r.json")]) == 0
    (tmp_path / "l.json.lock").write_text("other")
    assert main(["review", *files, "--action", "start", "--stage", "triage"]) == 2
    assert (tmp_path / "l.json.lock").read_text() == "other"
    assert b"REVIEW_BUSY" in capfdbinary.readouterr().err


def test_page_escapes(spark):
    e = {"record_id": "<r>", "official_source": "javascript:alert(1)", "retrieved_at": "2025-01-01T00:00:00Z", "as_of": "2024-12-31", "matched_effective_from": "2020-01-01", "matched_effective_to": None, "matched_title": 'A"', "matched_provision": None, "version_transition": None}
    page = evidentia.render_review(report(item("<b>'x'", evidence=[e, e | {"official_source": "https://example.com/a"}])), spark=spark)
    assert "&lt;b&gt;&#x27;x&#x27;" in page and 'href="https://example.com/a"' in page and "href=\"javascript" not in page and "unreviewed" in page


@pytest.mark.parametrize("meanwhile", ["gone", "broken", "other", "folder"])
def test_a_ledger_that_changes_under_way_is_a_conflict(tmp_path, monkeypatch, meanwhile):
    """Gone, no JSON any more, another ledger, or no file: nothing is written, and what is there stays."""
    made, book = tmp_path / "r.json", tmp_path / "l.json"
    made.write_text(json.dumps(report(item("A"))))
    ledger_store.update_ledger(book, made, action="start", stage="triage")
    plain = ledger_store.append_event

    def change(*args, **more):
        after = plain(*args, **more)
        if meanwhile == "broken":
            book.write_text("{")
        elif meanwhile == "other":
            book.write_text(book.read_text() + " ")
            book.write_text(json.dumps(json.loads(book.read_text()) | {"events": []}))
        else:
            book.unlink()
            if meanwhile == "folder":
                book.mkdir()
        return after

    monkeypatch.setattr(ledger_store, "append_event", change)
    with pytest.raises(EvidenceError) as e:
        ledger_store.update_ledger(book, made, action="finish", stage="triage")
    assert e.value.code == "REVIEW_CONFLICT"
    assert not list(tmp_path.glob(".l.json.*")) and not (tmp_path / "l.json.lock").exists()
    assert book.exists() == (meanwhile != "gone")
    if meanwhile == "broken":
        assert book.read_text() == "{"
