"""The data source of archives against the table function over whole files."""

import random
import zipfile

import pytest

from evidentia.sources import archives, hwpx

XML = '<?xml version="1.0" encoding="UTF-8"?><s xmlns:h="urn:h">{}</s>'


def write(path, sections, mimetype=hwpx.MIMETYPE, stored=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        if mimetype is not None:
            z.writestr("mimetype", mimetype)
        for name, xml in sections.items():
            z.writestr(name, xml)


def texts(rng, n, size=30):
    return XML.format("".join(f"<h:t>{''.join(rng.choice('abc 가나') for _ in range(size))}</h:t>" for _ in range(n)))


def told(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    (top / "deep").mkdir()
    rng = random.Random(4)
    many = {f"Contents/section{i}.xml": texts(rng, 40) for i in range(12)}
    write(top / "large.hwpx", many)
    write(top / "deep" / "broken section.hwpx", many | {"Contents/section7.xml": "<s><open></s>", "Contents/section9.xml": "<s>"})
    write(top / "doctype.hwpx", many | {"Contents/section11.xml": "<!DOCTYPE x><s/>"})
    write(top / "mimetype.hwpx", many, b"text/plain")
    write(top / "deepest.hwpx", many | {"Contents/section3.xml": "<a>" * 200 + "</a>" * 200})
    write(top / "empty.hwpx", {f"Contents/section{i}.xml": XML.format("<p>" + "x" * 900 + "</p>") for i in range(9)})
    write(top / "no section.hwpx", {"Contents/other.xml": "<s/>"})
    write(top / "two of a number.hwpx", {"Contents/section0.xml": texts(rng, 90), "Contents/section00.xml": texts(rng, 90)})
    (top / "none.hwpx").write_bytes(b"no archive" * 9000)
    (top / "zero.hwpx").write_bytes(b"")
    write(top / "damaged.hwpx", many, stored=True)
    data = bytearray((top / "damaged.hwpx").read_bytes())
    at = data.find(b"<h:t>", len(data) // 2)
    data[at + 6] ^= 1  # the checksum of that section fails
    (top / "damaged.hwpx").write_bytes(bytes(data))
    write(top / "other.txt", many)
    for i in range(20):
        hwpx.write_document(top / f"small {i}.hwpx", [f"text {i}", "", "more"])
    return top


@pytest.mark.parametrize("split", [1, 3000, 20_000, 1 << 30])
def test_source_equals_the_table_function(spark, folder, split):
    want = told(hwpx.read_documents(spark, str(folder)))
    got = archives.read_archives(spark, str(folder), splitBytes=str(split))
    # a file of no bytes is no split of binaryFile, but an archive that cannot be read to the source
    nothing = [r for r in told(got) if r[0].endswith("zero.hwpx")]
    assert [r[7] for r in nothing] == ["DOCUMENT_NOT_ZIP"]
    assert [r for r in told(got) if r not in nothing] == want and len({r[0] for r in want}) == 30
    if split == 3000:
        raw = archives.raw_archives(spark, str(folder), splitBytes=str(split))
        assert raw.where("section_rank = -1").count() >= 5


@pytest.mark.parametrize("limits", [hwpx.Limits(elements=300), hwpx.Limits(texts=200), hwpx.Limits(characters=5000), hwpx.Limits(characters=41 * 30)])
def test_budgets_are_summed_over_the_tasks_of_an_archive(spark, folder, limits, monkeypatch):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hwpx").option("recursiveFileLookup", "true").load(str(folder))
    want = told(hwpx.parse_documents(files, limits).where("path LIKE '%section%' OR path LIKE '%large%' OR path LIKE '%doctype%'"))
    raw = archives.raw_archives(spark, str(folder), splitBytes="3000").where("path LIKE '%section%' OR path LIKE '%large%' OR path LIKE '%doctype%'")
    assert told(archives.settled(raw, limits)) == want
    assert any(r[7] == "HWPX_LIMIT_EXCEEDED" for r in want)


def test_partitions_follow_the_directories(folder, monkeypatch):
    reader = archives.HwpxReader({"path": str(folder), "splitBytes": "3000"})
    parts = reader.partitions()
    large = [p for p in parts if isinstance(p, archives.Sections) and p.path.endswith("large.hwpx")]
    assert len(large) >= 6 and [p.first for p in large] == [True] + [False] * (len(large) - 1) and sum((p.ranks for p in large), []) == list(range(12))
    assert sum(len(p.paths) for p in parts if isinstance(p, archives.Archives)) + len({p.path for p in parts if isinstance(p, archives.Sections)}) == 31
    reader = archives.HwpxReader({"path": str(folder)})
    left = list(reader.pushFilters([archives.EqualTo(("path",), archives.uri(str(folder / "large.hwpx"))), archives.EqualTo(("ordinal",), 1)]))
    assert [f.attribute for f in left] == [("ordinal",)]
    assert [p.paths for p in reader.partitions()] == [[str(folder / "large.hwpx")]]


def test_filters_on_the_path_reach_the_planner(spark, folder):
    one = archives.raw_archives(spark, str(folder)).where(f"path = '{archives.uri(str(folder / 'small 3.hwpx'))}'")
    assert [r["text"] for r in one.orderBy("ordinal").collect()] == ["text 3", "more"]
    assert archives.read_archives(spark, str(folder / "deep")).select("error_code").distinct().collect()[0][0] == "HWPX_XML_INVALID"


def test_a_large_archive_is_read_by_several_tasks(spark, tmp_path):
    """200 MiB, unpacked, of sections of 10 MiB each."""
    body = ("<t>" + "x" * 1000 + "</t>") * 990 + "<p>" + " " * (9 << 20) + "</p>"
    write(tmp_path / "huge.hwpx", {f"Contents/section{i}.xml": f"<s>{body}</s>" for i in range(19)})
    raw = archives.raw_archives(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() >= 10
    rows = archives.settled(raw)
    assert rows.count() == 19 * 990 and rows.where("error_code IS NOT NULL").count() == 0
