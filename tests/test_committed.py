"""All or none: the sink of files, and a folder that changes while it is scanned."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evidentia.operators.report import as_json
from evidentia.plans import scan
from evidentia.sources import bulk, committed, hwpx
from evidentia.sources.catalog import catalog_frames
from tests.test_scan import AS_OF, CATALOG


def save(frame, folder):
    frame.write.format("committed").option("path", str(folder)).mode("append").save()


def test_every_row_is_a_file(spark, tmp_path):
    committed.register(spark)
    pages = spark.range(40).select(F.format_string("page-%s.html", "id").alias("name"), F.concat(F.lit("<p>é "), F.col("id").cast("string")).cast("binary").alias("content")).repartition(5)
    save(pages, tmp_path)
    assert sorted(os.listdir(tmp_path)) == sorted(f"page-{i}.html" for i in range(40))
    assert (tmp_path / "page-7.html").read_bytes() == "<p>é 7".encode()
    with pytest.raises(Exception, match="REVIEW_OUTPUT_EXISTS"):  # one name is taken: none of the new ones stays
        save(pages.where("name = 'page-7.html'").unionByName(spark.createDataFrame([(f"new-{i}", b"x") for i in range(6)], "name string, content binary")), tmp_path)
    assert sorted(os.listdir(tmp_path)) == sorted(f"page-{i}.html" for i in range(40)) and (tmp_path / "page-7.html").read_bytes() == "<p>é 7".encode()


def test_reports_of_a_scan_as_files(spark, tmp_path):
    catalog = catalog_frames(spark, json.dumps(CATALOG).encode())
    (tmp_path / "docs").mkdir()
    for n in "abc":
        hwpx.write_document(tmp_path / "docs" / f"{n}.hwpx", ["모의장서기준 제12조", n])
    files = spark.read.format("binaryFile").load(str(tmp_path / "docs"))
    told = as_json(scan.scan_documents(spark, files, catalog, AS_OF))
    committed.save(told, str(tmp_path / "out"), F.concat(F.regexp_extract("path", "([a-z])[.]hwpx", 1), F.lit(".json")), F.col("json"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json", "c.json"]
    read = bulk.reports(bulk.read_files(spark, str(tmp_path / "out")))
    assert [(r["error_code"], len(r["items"])) for r in read.collect()] == [(None, 1)] * 3


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    committed.register(spark)
    rows = spark.range(20).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("fails"))).otherwise("x").cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception, match="fails"):
        save(rows, tmp_path)
    assert os.listdir(tmp_path) == []
    for bad in ("../up", "a/b", ".hidden", ""):
        with pytest.raises(Exception, match="REVIEW_PATH_INVALID"):
            save(spark.createDataFrame([(bad, b"x")], "name string, content binary"), tmp_path)
    assert os.listdir(tmp_path) == []


def test_a_repeated_task_leaves_one_file(tmp_path):
    """Two attempts of a task both write; the job counts one of them."""
    writer = committed.CommittedWriter(str(tmp_path), ["content", "name"])
    lost, kept = (writer.write(iter([(b"one", "a"), (b"two", "b")])) for _ in range(2))
    assert lost.files != kept.files
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "b").read_bytes() == b"two"
    again = committed.CommittedWriter(str(tmp_path), ["name", "content"])
    again.write(iter([("c", "text")]))
    again.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_what_changes_under_way_is_void(spark, tmp_path, monkeypatch):
    catalog = catalog_frames(spark, json.dumps(CATALOG).encode())
    folder = tmp_path / "docs"
    (folder / "deep").mkdir(parents=True)
    names = ["same", "longer", "gone", "touched", "deep/also longer"]
    for n in names:
        hwpx.write_document(folder / f"{n}.hwpx", ["모의장서기준 제12조", n])
    plain = scan.scan_documents

    def meanwhile(*args, **kwargs):
        reports = plain(*args, **kwargs).persist()
        assert reports.count() == len(names)
        for n in ("longer", "deep/also longer"):
            (folder / f"{n}.hwpx").write_bytes((folder / f"{n}.hwpx").read_bytes() + b"more")
        (folder / "gone.hwpx").unlink()
        os.utime(folder / "touched.hwpx", (1, 1))
        hwpx.write_document(folder / "new.hwpx", ["new"])
        return reports

    monkeypatch.setattr(scan, "scan_documents", meanwhile)
    got = {r["path"].split("/docs/")[1]: r for r in scan.scan_whole_folder(spark, str(folder), catalog, AS_OF, str(tmp_path / "out")).collect()}
    assert {k: (len(r["items"]), [e["code"] for e in r["collection_errors"]]) for k, r in got.items()} == {f"{n}.hwpx": (1, []) if n == "same" else (0, ["SOURCE_CHANGED_DURING_SCAN"]) for n in names}
    assert all(r["document_sha256"] for r in got.values())


def test_a_change_that_keeps_length_and_time(spark, tmp_path, monkeypatch):
    catalog = catalog_frames(spark, json.dumps(CATALOG).encode())
    folder = tmp_path / "docs"
    folder.mkdir()
    hwpx.write_document(folder / "a.hwpx", ["모의장서기준 제12조"])
    hwpx.write_document(folder / "b.hwpx", ["모의장서기준 제12조"])
    plain = scan.scan_documents

    def meanwhile(*args, **kwargs):
        reports = plain(*args, **kwargs).persist()
        reports.count()
        info, data = (folder / "b.hwpx").stat(), bytearray((folder / "b.hwpx").read_bytes())
        data[-1] ^= 1
        (folder / "b.hwpx").write_bytes(bytes(data))
        os.utime(folder / "b.hwpx", ns=(info.st_atime_ns, info.st_mtime_ns))
        return reports

    monkeypatch.setattr(scan, "scan_documents", meanwhile)
    told = lambda out, **o: {r["path"][-6:]: [e["code"] for e in r["collection_errors"]] for r in scan.scan_whole_folder(spark, str(folder), catalog, AS_OF, str(tmp_path / out), **o).collect()}
    assert told("plain") == {"a.hwpx": [], "b.hwpx": []}
    assert told("hashed", rehash=True) == {"a.hwpx": [], "b.hwpx": ["SOURCE_CHANGED_DURING_SCAN"]}
