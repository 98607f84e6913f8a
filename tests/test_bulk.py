"""Bulk reading and binding against the functions for single files."""

import json
import random


from evidentia.errors import EvidenceError
from evidentia.operators import binding, resolve
from evidentia.sources import bulk, strict_json
from evidentia.sources.ledger_store import append_event, new_ledger
from evidentia.sources.reports import validate_ledger, validate_report

ODD = ['quote " and \\ back', "tab\tnewline\n", "\x0b\x0e\x1b\x1f\x7f", "\\u001B as text \\\x1b", "é 東京 \U0001f600  ", "/slash </tag>"]


def random_report(rng):
    text = lambda: rng.choice(ODD) + str(rng.randrange(9))
    maybe = lambda x: x if rng.random() < 0.6 else None
    day = lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}"

    def proof():
        return {"record_id": text(), "official_source": "https://x.example.org/", "retrieved_at": "2024-01-01T00:00:00Z", "as_of": day(), "matched_effective_from": day(), "matched_effective_to": maybe(day()), "matched_title": text(), "matched_provision": maybe(text()), "version_transition": maybe({"effective_from": day(), "title": text(), "provision": maybe(text())})}

    items = [{"locator": text(), "reference": {"title": maybe(text()), "provision": maybe(text())}, "status": rng.choice(["CURRENT", "HISTORY", "REVIEW", "UNKNOWN"]), "reason_code": text(), "evidence": [proof() for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(4))]
    errors = [{"code": text(), "stage": "parse", "fatal": rng.random() < 0.5, "locator": maybe(text()), "message": text()} for _ in range(rng.randrange(2))]
    return {"schema_version": "1", "document_name": text(), "document_sha256": f"{rng.randrange(1 << 60):064x}", "as_of": day(), "catalog_sha256": "c" * 64, "items": items, "collection_errors": errors}


def files(spark, contents):
    return spark.createDataFrame([(f"f{i:03}", len(c), bytearray(c)) for i, c in enumerate(contents)], "path string, length long, content binary").repartition(3)


def test_digest_of_typed_columns_is_that_of_the_value(spark):
    rng = random.Random(1)
    made = [random_report(rng) for _ in range(120)]
    dumped = [json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode() for r in made]
    rows = bulk.reports(files(spark, dumped)).withColumn("column_digest", binding.report_digest()).withColumn("text", binding.canonical_report()).collect()
    assert len(rows) == len(made) and all(r["error_code"] is None for r in rows)
    for r in rows:
        report = made[int(r["path"][1:])]
        assert r["text"].encode() == strict_json.canonical(report)
        assert r["report_digest"] == r["column_digest"] == strict_json.digest(report)


def bend(rng, data):
    """One of many small changes to a JSON text."""
    value = json.loads(data)
    kind = rng.randrange(9)
    if kind == 0:
        return data[: rng.randrange(len(data))]
    if kind == 1:
        return data.replace(b'"as_of"', b'"as_of":"x","as_of"', 1)
    if kind == 2:
        return b"\xef\xbb\xbf" + data
    if kind == 3:
        value[rng.choice(list(value))] = rng.choice([None, 1, "", [], {}, True, "\ud800"])
    if kind == 4:
        value["more"] = 1
    if kind == 5:
        del value[rng.choice(list(value))]
    if kind == 6:
        return b"[" + data + b"]"
    if kind == 7:
        value["as_of"] = rng.choice(["20240101", "2024-13-01", "2024-01-01T00:00:00Z"])
    if kind == 8:
        return data.replace(b"null", b"NaN").replace(b"1", b"1e999", 1)
    return json.dumps(value).encode()


def one_by_one(data, check):
    try:
        check(bulk.strict_object(data))
    except EvidenceError as e:
        return e.code
    return None


def test_bent_reports_are_refused_one_by_one(spark):
    rng = random.Random(2)
    contents = [bend(rng, json.dumps(random_report(rng)).encode()) for _ in range(300)] + [json.dumps(random_report(rng)).encode() for _ in range(9)] + [b"", b"\xff", b"{}", b"[]", b"1" * 5000, b'{"a":' * 40 + b"1" + b"}" * 40]
    got = {r["path"]: r["error_code"] for r in bulk.reports(files(spark, contents)).collect()}
    want = {f"f{i:03}": one_by_one(c, validate_report) for i, c in enumerate(contents)}
    assert got == want and set(got.values()) >= {None, "REVIEW_JSON_INVALID", "REVIEW_REPORT_INVALID"}


def test_large_files_are_refused_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(strict_json, "MAX_BYTES", 2000)
    report = json.dumps(random_report(random.Random(5)) | {"items": [], "collection_errors": []}).encode()
    (tmp_path / "small.json").write_bytes(report)
    (tmp_path / "large.json").write_bytes(report + b" " * 3000)
    read = bulk.validated(bulk.read_files(spark, str(tmp_path)), bulk.report_row, bulk.REPORTS, bulk.TOO_LARGE, max_bytes=2000)
    assert {r["path"].rsplit("/", 1)[-1]: r["error_code"] for r in read.collect()} == {"small.json": None, "large.json": "REVIEW_JSON_INVALID"}
    assert read._jdf.queryExecution().executedPlan().toString().count("LessThanOrEqual(length") >= 1


def test_ledgers_bind_to_their_report_only(spark):
    rng = random.Random(3)
    made = [r for r in (random_report(rng) for _ in range(60)) if r["items"]]
    books = []
    for i, r in enumerate(made):
        book = new_ledger(r)
        for n in range(rng.randrange(4)):
            book = append_event(book, r, "decide", item_number=rng.randrange(len(r["items"])) + 1, disposition="defer") if n % 2 else append_event(book, r, "start", stage="triage")
        if i % 5 == 1:
            book["report_digest"] = "0" * 64
        if i % 5 == 2:
            book = new_ledger(made[i - 1] if i else r) | {"document_sha256": r["document_sha256"]}
        if i % 5 == 3 and book["events"]:
            book["events"][0]["at"] = "2030-01-01T00:00:00Z"
        if i % 5 == 4:
            event = {"sequence": 1, "action": "decide", "item_number": len(r["items"]) + (i % 2), "disposition": "defer", "stage": None, "at": "2030-01-01T00:00:00Z", "previous_event_digest": None}
            book["events"] = [event | {"digest": strict_json.digest(event)}]
        books.append(book)
    reports = bulk.reports(files(spark, [json.dumps(r).encode() for r in [*made, made[0]]] + [b"{"]))
    bound = {r["path"]: r for r in binding.bind(bulk.ledgers(files(spark, [json.dumps(b).encode() for b in books] + [b"x"])), reports).collect()}
    assert bound[f"f{len(books):03}"]["error_code"] == "REVIEW_JSON_INVALID" and len(bound) == len(books) + 1
    for i, (book, r) in enumerate(zip(books, made, strict=True)):
        got, want = bound[f"f{i:03}"], one_by_one(json.dumps(book).encode(), lambda b, r=r: validate_ledger(b, r))
        assert got["error_code"] == want, i
        if want is None:
            assert (got["report_path"], got["n_items"], [e["digest"] for e in got["events"]]) == (f"f{i:03}", len(r["items"]), [e["digest"] for e in book["events"]])
        else:
            assert got["report_path"] is None and got["events"] is None


def test_catalogs_and_items_as_tables(spark):
    record = lambda k, title: {"record_id": k, "official_source": {"url": "https://a.example.org/", "retrieved_at": "2024-01-01T00:00:00Z"}, "versions": [{"effective_from": "2020-01-01", "effective_to": None, "title": title, "provisions": [{"canonical_id": "p", "label": "one"}]}]}
    catalogs = [{"schema_version": "1", "records": [record("a", "T"), record("b", "U")]}, {"schema_version": "1", "records": [record("a", "T"), record("a2", "T")]}, {"schema_version": "2", "records": []}, {"schema_version": "1", "records": []}]
    read = bulk.catalogs(files(spark, [json.dumps(c).encode() for c in catalogs] + [b"{"]))
    assert {r["path"]: r["error_code"] for r in bulk.refused(read).collect()} == {"f002": "CATALOG_SCHEMA_UNSUPPORTED", "f003": "CATALOG_SCHEMA_INVALID", "f004": "CATALOG_JSON_INVALID"}
    kept = bulk.accepted(read)
    v, p = bulk.versions(kept), bulk.provisions(kept)
    refs = spark.createDataFrame([("f000", "T", "one"), ("f001", "T", "one"), ("f000", "X", None), ("f000", None, None), ("f002", "T", "one")], "catalog string, title string, provision string")
    got = {(r["catalog"], r["title"]): r["reason_code"] for r in resolve.attach(refs, v, p, "2024-01-01", by=("catalog",)).collect()}
    assert got == {("f000", "T"): "EXACT_CURRENT_MATCH", ("f001", "T"): "CONFLICTING_EVIDENCE", ("f000", "X"): "CATALOG_NO_MATCH", ("f000", None): "AMBIGUOUS_CITATION", ("f002", "T"): "CATALOG_NO_MATCH"}
    rng = random.Random(4)
    made = [random_report(rng) for _ in range(10)]
    rows = bulk.items(bulk.accepted(bulk.reports(files(spark, [json.dumps(r).encode() for r in made])))).orderBy("path", "item_number").collect()
    assert [(r["path"], r["item_number"], r["locator"], r["title"]) for r in rows] == [(f"f{i:03}", n, x["locator"], x["reference"]["title"]) for i, r in enumerate(made) for n, x in enumerate(r["items"], 1)]
    assert bulk.events(bulk.accepted(bulk.ledgers(files(spark, [json.dumps(new_ledger(made[0])).encode()])))).count() == 0


def test_documents_each_with_their_own_catalog(spark):
    """In one plan what scanning each document with its catalog alone gives; refused and missing catalogs are told."""
    from evidentia.operators.report import as_json
    from evidentia.plans import scan
    from evidentia.plans.demo import CATALOG
    from evidentia.sources import hwpx
    from evidentia.sources.catalog import catalog_frames

    other = json.loads(json.dumps(CATALOG))
    other["records"] = other["records"][:1]
    catalogs = {"one": json.dumps(CATALOG).encode(), "two": json.dumps(other).encode(), "bad": b"{"}
    texts = [["모의장서기준 제12조"], ["다른 훈령", "모의장서기준 제12조, 모의장서기준"], ["none"]]
    archives = [(f"d{i}", hwpx.archive(texts[i % 3]), c) for i, c in enumerate(["one", "two", "one", "two", "one", "bad", "gone", None, "two"])] + [("x", b"no archive", "one")]
    frame = spark.createDataFrame([(p, bytearray(a), c) for p, a, c in archives], "path string, content binary, catalog string")
    files_of = spark.createDataFrame([(p, bytearray(c)) for p, c in catalogs.items()], "path string, content binary")
    for budgets in ({}, {"candidates_document": 1}):
        reports, refused = scan.scan_by_catalog(spark, frame, bulk.catalogs(files_of), "2025-06-30", **budgets)
        got = {r["path"]: json.loads(r["json"]) for r in as_json(reports).collect()}
        assert {r["path"]: r["error_code"] for r in refused.collect()} == {"d5": "CATALOG_JSON_INVALID", "d6": "CATALOG_NOT_FOUND", "d7": "CATALOG_NOT_FOUND"}
        want = {}
        for name in ("one", "two"):
            alone = scan.scan_documents(spark, frame.where(f"catalog = '{name}'").drop("catalog"), catalog_frames(spark, catalogs[name]), "2025-06-30", **budgets)
            want |= {r["path"]: json.loads(r["json"]) for r in as_json(alone).collect()}
        assert got == want and len(got) == 7 and any(r["items"] for r in got.values())


def test_files_that_change_while_they_are_read_are_refused(spark, tmp_path):
    rng = random.Random(8)
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    made = {n: random_report(rng) for n in ("a", "b", "deep/c", "d")}
    for n, r in made.items():
        (folder / f"{n}.json").write_text(json.dumps(r))
    (folder / "e.json").write_text("{")

    def meanwhile(files):
        rows = bulk.reports(files).persist()
        assert rows.count() == 5
        (folder / "b.json").write_text(json.dumps(made["b"]) + " ")
        (folder / "deep/c.json").unlink()
        return rows

    got = {r["path"].split("/in/")[1]: r for r in bulk.read_stable(spark, str(folder), meanwhile, str(tmp_path / "out")).collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {"a.json": None, "b.json": "REVIEW_JSON_INVALID", "deep/c.json": "REVIEW_JSON_INVALID", "d.json": None, "e.json": "REVIEW_JSON_INVALID"}
    assert got["b.json"]["items"] is None and got["a.json"]["report_digest"] == strict_json.digest(made["a"])
