"""A folder scanned as a stream: only new documents are scanned, each has one report."""

import json

from evidentia.plans.demo import AS_OF, CATALOG, TEXTS
from evidentia.sources.catalog import catalog_frames
from evidentia.sources.hwpx import read_documents, write_document
from evidentia.streaming.folders import scan_folder


def test_folder_as_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    catalog = catalog_frames(spark, json.dumps(CATALOG).encode())
    write_document(folder / "a.hwpx", TEXTS)
    (folder / "b.hwpx").write_bytes(b"no archive")

    def run():
        scan_folder(spark, str(folder), catalog, AS_OF, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {r["path"].rsplit("/", 1)[-1]: json.loads(r["json"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = run()
    assert [i["status"] for i in first["a.hwpx"]["items"]] == ["CURRENT", "HISTORY", "REVIEW", "UNKNOWN"]
    assert first["b.hwpx"]["items"] == [] and first["b.hwpx"]["collection_errors"][0]["code"] == "DOCUMENT_NOT_ZIP"
    write_document(folder / "c.hwpx", TEXTS[:1])
    assert set(run()) == {"a.hwpx", "b.hwpx", "c.hwpx"}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert read_documents(spark, str(folder)).where("text IS NOT NULL").count() == 5
