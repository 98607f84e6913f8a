"""Documents, catalogs and scans on small fixtures."""

import json
import random
import zipfile
from datetime import date, datetime

import pytest

from evidentia.errors import EvidenceError
from evidentia.operators import extract, resolve
from evidentia.plans.demo import AS_OF, CATALOG, catalog_of, create_demo
from evidentia.plans.scan import scan_document, scan_documents
from evidentia.sources import hwpx
from evidentia.sources.catalog import catalog_frames, parse_catalog


def report_of(spark, tmp_path, texts, catalog=CATALOG, as_of=date.fromisoformat(AS_OF)):
    hwpx.write_document(tmp_path / "d.hwpx", texts)
    (tmp_path / "c.json").write_text(json.dumps(catalog, ensure_ascii=False))
    return scan_document(spark, tmp_path / "d.hwpx", as_of, tmp_path / "c.json")


def test_demo_shows_four_statuses(spark, tmp_path):
    made = create_demo(tmp_path / "demo")
    report = scan_document(spark, tmp_path / "demo" / made["document"], date.fromisoformat(AS_OF), tmp_path / "demo" / made["catalog"])
    assert [i["status"] for i in report["items"]] == ["CURRENT", "HISTORY", "REVIEW", "UNKNOWN"]
    assert [i["reason_code"] for i in report["items"]] == ["EXACT_CURRENT_MATCH", "EXACT_HISTORICAL_MATCH", "PROVISION_MISMATCH", "AMBIGUOUS_CITATION"]
    assert report["items"][1]["evidence"][0]["version_transition"] == {"effective_from": "2024-01-15", "title": "모의열람규칙", "provision": "제5조"}
    assert report["items"][2]["evidence"][0]["matched_provision"] is None
    with pytest.raises(EvidenceError):
        create_demo(tmp_path / "demo")


def test_text_order_lookahead_and_ordinals(spark, tmp_path):
    catalog = catalog_of([("a", "2020-01-01", None, "서고규정고시", "x", "제2조"), ("b", "2020-01-01", None, "규정", "x", "제4조")])
    report = report_of(spark, tmp_path, ["", "예규 서고규정고시 제2조 규정 제4조 다른 법", "", "규정" + " " * 31 + "제4조"], catalog)
    told = [(i["locator"], i["reference"]["title"], i["reference"]["provision"]) for i in report["items"]]
    place = "Contents/section0.xml:t"
    assert told == [(f"{place}[2]", None, None), (f"{place}[2]", "서고규정고시", "제2조"), (f"{place}[2]", "규정", "제4조"), (f"{place}[4]", "규정", None)]


def test_conflict_and_future_version(spark, tmp_path):
    twice = {"schema_version": "1", "records": [CATALOG["records"][1], CATALOG["records"][1] | {"record_id": "copy"}]}
    report = report_of(spark, tmp_path, ["모의열람지침 제3조", "모의열람규칙 제5조", "모의열람규칙 제1조"], twice)
    assert [(i["reason_code"], len(i["evidence"])) for i in report["items"]] == [("CONFLICTING_EVIDENCE", 2), ("CONFLICTING_EVIDENCE", 2), ("CATALOG_NO_MATCH", 0)]


@pytest.mark.parametrize(
    "build, code",
    [
        (lambda p: p.write_bytes(b"no archive"), "DOCUMENT_NOT_ZIP"),
        (lambda p: archive(p, {"mimetype": b"text/plain", "Contents/section0.xml": b"<s/>"}), "HWPX_MIMETYPE_INVALID"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE}), "HWPX_SECTION_MISSING"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<!DOCTYPE s><s/>"}), "HWPX_XML_INVALID"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": "<s/>".encode("utf-16")}), "HWPX_XML_INVALID"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<s><t>"}), "HWPX_XML_INVALID"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<s/>", "Contents/section00.xml": b"<s/>"}), "HWPX_XML_INVALID"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, f"Contents/section{'1' * 33}.xml": b"<s/>"}), "HWPX_LIMIT_EXCEEDED"),
        (lambda p: archive(p, {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<s/>"}, zipfile.ZIP_BZIP2), "DOCUMENT_NOT_ZIP"),
    ],
)
def test_refused_documents(tmp_path, build, code):
    build(tmp_path / "d.hwpx")
    nodes, error = hwpx.parse((tmp_path / "d.hwpx").read_bytes())
    assert not nodes and error.code == code


def archive(path, entries, how=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, data in entries.items():
            z.writestr(name, data)


def test_budgets_of_documents(tmp_path):
    archive(tmp_path / "d", {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<s><p><t>ab<i>x</i>tail</t></p></s>", "Contents/section10.xml": b"<s><t/></s>", "Contents/section9.xml": b"<s><t/><t>c</t></s>"})
    data = (tmp_path / "d").read_bytes()
    assert hwpx.parse(data)[0] == [(0, "Contents/section0.xml", 1, "ab"), (1, "Contents/section9.xml", 2, "c")]
    for limit, value in (("elements", 8), ("texts", 3), ("depth", 3), ("characters", 2), ("entries", 3)):
        assert hwpx.parse(data, hwpx.Limits(**{limit: value}))[1].code == "HWPX_LIMIT_EXCEEDED"
    assert hwpx.parse(data, hwpx.Limits(elements=9, texts=4, depth=4, characters=3, entries=4))[1] is None


def test_refusals_that_tell_more_and_unread_archives(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a", {"mimetype": hwpx.MIMETYPE, "Contents/section0.xml": b"<s/>", "Contents/section00.xml": b"<s/>"})
    assert hwpx.parse((tmp_path / "a").read_bytes())[1].message == "HWPX section layout is ambiguous."
    assert hwpx.parse(b"no archive")[1].message == "Document is not a readable ZIP archive."
    hwpx.write_document(tmp_path / "big.hwpx", ["x" * 99])
    hwpx.write_document(tmp_path / "d.hwpx", ["x"])
    monkeypatch.setattr(hwpx, "READ_BYTES", (tmp_path / "d.hwpx").stat().st_size)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in hwpx.read_documents(spark, str(tmp_path)).collect()}
    assert got["big.hwpx"]["error_code"] == "HWPX_LIMIT_EXCEEDED" and got["big.hwpx"]["document_sha256"] is None and got["d.hwpx"]["text"] == "x"


def test_scan_parses_once_and_voids_over_budget(spark, tmp_path):
    catalog = catalog_frames(spark, json.dumps(CATALOG).encode())
    hwpx.write_document(tmp_path / "a.hwpx", ["모의장서기준 제12조", "다른 훈령"])
    hwpx.write_document(tmp_path / "b.hwpx", ["nothing of note"])
    (tmp_path / "c.hwpx").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    plan = scan_documents(spark, files, catalog, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") <= 2  # read files, and those too large to read
    told = lambda **budgets: {r["path"].rsplit("/", 1)[-1]: (len(r["items"]), [e["code"] for e in r["collection_errors"]]) for r in scan_documents(spark, files, catalog, AS_OF, **budgets).collect()}
    assert told() == {"a.hwpx": (2, []), "b.hwpx": (0, []), "c.hwpx": (0, ["DOCUMENT_NOT_ZIP"])}
    assert told(candidates_document=1) == {"a.hwpx": (0, ["REFERENCE_LIMIT_EXCEEDED"]), "b.hwpx": (0, []), "c.hwpx": (0, ["DOCUMENT_NOT_ZIP"])}


def test_over_budget_voids_the_document(spark, tmp_path):
    rows = [("a", 0, "x규정 규정"), ("b", 0, "규정")]
    nodes = spark.createDataFrame(rows, "path string, ordinal int, text string")
    titles = spark.createDataFrame([("규정",)], "title string")
    found = extract.mentions(nodes, titles, ["path", "ordinal"])
    assert {r["path"]: r["matches"] for r in found.collect()} == {"a": 4, "b": 2}
    assert [r["path"] for r in extract.over_budget(found, "path", candidates_document=1).collect()] == ["a"]
    assert extract.over_budget(found, "path").count() == 0


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda c: c.update(schema_version="2"), "CATALOG_SCHEMA_UNSUPPORTED"),
        (lambda c: c.update(schema_version=1), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c.update(more=1), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][0]["versions"][0].pop("effective_to"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][0]["versions"][0].update(effective_from="20200101"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][1]["versions"][0].update(effective_to="2024-01-16"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][1]["versions"][1].update(effective_to="2026-02-02"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][0]["official_source"].update(url="http://example.com"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][0]["official_source"].update(url="https://u@example.com"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"][0]["official_source"].update(retrieved_at="2025-03-01 09:00:00Z"), "CATALOG_SCHEMA_INVALID"),
        (lambda c: c["records"].append(c["records"][0]), "CATALOG_SCHEMA_INVALID"),
    ],
)
def test_refused_catalogs(change, code):
    catalog = json.loads(json.dumps(CATALOG))
    change(catalog)
    with pytest.raises(EvidenceError) as e:
        parse_catalog(json.dumps(catalog).encode())
    assert e.value.code == code


@pytest.mark.parametrize("data", [b"{", b'{"a":1,"a":2}', b'{"a":NaN}', b"\xff", b'{"a":' + b"1" * 5000 + b"}"])
def test_catalog_json_is_strict(data):
    with pytest.raises(EvidenceError) as e:
        parse_catalog(data)
    assert e.value.code == "CATALOG_JSON_INVALID"


def test_requests(spark, tmp_path):
    with pytest.raises(EvidenceError) as e:
        scan_document(spark, tmp_path / "none", date(2024, 1, 1), tmp_path / "c")
    assert e.value.code == "DOCUMENT_NOT_FOUND"
    hwpx.write_document(tmp_path / "d.hwpx", ["x"])
    (tmp_path / "c").write_text("{")
    with pytest.raises(EvidenceError) as e:
        scan_document(spark, tmp_path / "d.hwpx", datetime(2024, 1, 1), tmp_path / "c")
    assert e.value.code == "AS_OF_TYPE_INVALID"
    (tmp_path / "c").unlink()
    with pytest.raises(EvidenceError) as e:
        scan_document(spark, tmp_path / "d.hwpx", datetime(2024, 1, 1), tmp_path / "c")
    assert e.value.code == "CATALOG_NOT_FOUND"  # the request is checked in this order: document, catalog, date


def plain_mentions(text, titles, markers, form, ahead):
    """The rule in plain Python: longest title first, first marker that touches no chosen title."""
    taken, chosen = set(), []
    for t in sorted(set(titles), key=lambda t: (-len(t), t)):
        at = text.find(t)
        while at >= 0:
            span = set(range(at, at + len(t)))
            if not span & taken:
                taken |= span
                chosen.append((at, t))
            at = text.find(t, at + len(t))
    chosen.sort()
    out = []
    for i, (at, t) in enumerate(chosen):
        stop = min(at + len(t) + ahead, chosen[i + 1][0] if i + 1 < len(chosen) else len(text))
        m = form.search(text[at + len(t) : stop])
        out.append((at, t, m[0] if m else None))
    free = []
    for m in markers:
        at = text.find(m)
        while at >= 0:
            if not set(range(at, at + len(m))) & taken:
                free.append(at)
                break
            at = text.find(m, at + len(m))
    return sorted(out + ([(min(free), None, None)] if free else []), key=lambda x: x[0])


def test_mentions_against_plain_rule(spark, monkeypatch):
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc1 ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    titles, markers = ["ab", "abc", "ca", "b", "aab", "bca"], ["c", "1", "a "]
    nodes = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    words = spark.createDataFrame([(t,) for t in titles], "title string")
    options = {"provision": "1+", "lookahead": 4, "markers": markers}
    for held in (extract.AUTOMATON_TITLES, 0):
        monkeypatch.setattr(extract, "AUTOMATON_TITLES", held)
        got = {r["n"]: [tuple(c) for c in r["candidates"]] for r in extract.mentions(nodes, words, ["n"], **options).collect()}
        for n, text in enumerate(texts):
            assert got[n] == plain_mentions(text, titles, markers, re.compile("1+"), 4), (held, text)


def test_large_dictionary_with_null_keys(spark, monkeypatch):
    monkeypatch.setattr(extract, "AUTOMATON_TITLES", 0)
    nodes = spark.createDataFrame([(1, None, "x규정 규정"), (1, "a", "규정집은 규정"), (None, None, None)], "n int, m string, text string")
    titles = spark.createDataFrame([("규정",), ("규정집은",), ("none of these, a long title",), (None,), ("",)], "title string")
    got = {(r["n"], r["m"]): [tuple(h) for h in r["hits"]] for r in extract.with_hits(nodes, titles, ["n", "m"]).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {(1, None): [("규정", 1, 3), ("규정", 4, 6)], (1, "a"): [("규정", 0, 2), ("규정", 5, 7), ("규정집은", 0, 4)], (None, None): []}


def test_windows_cost_grows_with_the_text():
    """All windows of a long text that is not ASCII, and their hashes against each window taken by itself."""
    import time

    import numpy as np

    from evidentia.operators import rolling

    rng = random.Random(9)
    text = "".join(rng.choice("가나다라 ab") for _ in range(160_000))

    def seconds(n):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            windows = rolling.Windows([text[:n]])
            for lead in rolling.LEADS:
                windows.hashes(lead)
            best = min(best, time.perf_counter() - began)
        return best

    seconds(160_000)
    assert seconds(160_000) <= 5 * seconds(40_000) + 0.02
    parts = [text[:50], "", text[:5], text[7:60]]
    for lead in rolling.LEADS:
        at, grams = rolling.Windows(parts).hashes(lead)
        alone = [rolling.Windows([p[i : i + lead]]).hashes(lead)[1][0] for p in parts for i in range(len(p) - lead + 1)]
        assert grams.tolist() == alone and len(at) == len(alone) and len(np.unique(grams)) == len({p[i : i + lead] for p in parts for i in range(len(p) - lead + 1)})


def test_large_dictionary_against_the_automaton(spark, monkeypatch):
    rng = random.Random(12)
    syllable = lambda n: "".join(rng.choice("가나다라마바사") for _ in range(n))
    titles = spark.createDataFrame([(syllable(rng.randint(1, 30)),) for _ in range(400)] + [("가나",), ("가나다라마바사" * 4,)], "title string")
    nodes = spark.createDataFrame([(i, syllable(rng.randint(0, 300)) + ("가나다라마바사" * 5 if i % 9 == 0 else "")) for i in range(60)] + [(99, syllable(40_000))], "n int, text string").repartition(4)
    told = lambda: sorted((r["n"], r["matches"], [tuple(x) for x in r["selected"]]) for r in extract.mentions(nodes, titles, ["n"], columns=("selected", "matches")).collect())
    want = told()
    monkeypatch.setattr(extract, "AUTOMATON_TITLES", 100)
    assert told() == want and sum(n for _, n, _ in want) > 1000


def test_longer_leads_are_looked_up_where_the_least_passes(spark):
    """Windows among some places are those of all places there; every title has a short hash, and all titles are found."""
    import numpy as np

    from evidentia.operators import rolling

    rng = random.Random(21)
    parts = ["".join(rng.choice("ab 가") for _ in range(n)) for n in (0, 3, 90, 1, 40)]
    windows, among = rolling.Windows(parts), np.array([0, 2, 3, 50, 92, 93, 120, 133])
    for lead in rolling.LEADS:
        at, grams = windows.hashes(lead)
        some, told = windows.hashes(lead, among)
        kept = np.isin(at, among)
        assert some.tolist() == at[kept].tolist() and told.tolist() == grams[kept].tolist()
    texts = ["".join(rng.choice("ab 가") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    titles = sorted({t[i : i + n] for t in texts for n in (3, 4, 9, 17, 40) for i in [rng.randint(0, 150)] if len(t[i : i + n]) == n})
    known = spark.createDataFrame([(t,) for t in titles], "title string")
    assert {r["short"] for r in rolling.keyed(known).collect()} == set(rolling.Windows([t[:3] for t in titles]).hashes(3)[1].tolist())
    nodes = spark.createDataFrame([*enumerate(texts), (900, None)], "n int, text string")
    got = {r["n"]: {(h["title"], h["start"]) for h in r["hits"]} for r in extract.with_hits(nodes, known, ["n"], held=0).collect()}
    for n, text in enumerate(texts):
        d = extract.Dictionary.of(titles)
        want = {(d.titles[t], s) for t, s, _ in extract.occurrences(text, d)}
        assert got[n] == want
    assert got[900] == set() and sum(map(len, got.values())) > 300


def test_few_automata_stay():
    """A hundred dictionaries leave a bounded number of automata, the last ones; equal ones share theirs."""
    extract.Automata.built.clear()
    for i in range(100):
        assert extract.occurrences(f"see t{i} here", extract.Dictionary.of([f"t{i}", "see"]))[1][0] == 1
    assert len(extract.Automata.built) == extract.KEPT_AUTOMATA
    kept = extract.Automata.of(extract.Dictionary.of(["see", "t99", "t99"]))
    assert kept is extract.Automata.of(extract.Dictionary.of(["t99", "see"])) and len(extract.Automata.built) == extract.KEPT_AUTOMATA
    extract.Automata.of(extract.Dictionary.of(["x" * extract.KEPT_CHARS]))
    assert len(extract.Automata.built) == 1


def test_titles_longer_than_an_automaton_holds():
    long = ["ab" * 130, "ab" * 128, "ab" * 128 + "c", "ab" * 127 + "a", "b" * 100_000]
    d = extract.Dictionary.of(long)
    text = "ab" * 130 + " " + "ab" * 128 + "c" + "b" * 100_000
    plain = sorted((text.find(t, at), t) for t in long for at in [0] if text.find(t, at) >= 0)
    got = extract.occurrences(text, d)
    assert {(s, d.titles[i]) for i, s, _ in got} >= set(plain) and all(text[s:e] == d.titles[i] for i, s, e in got)


def test_many_catalogs_each_with_its_own_dictionary(spark):
    """10,000 catalogs, one of them with half of the nodes, against one dictionary at a time."""
    rng = random.Random(3)
    words = [a + b for a in "가나다라마" for b in "바사아자차"]
    titles = {c: rng.sample(words, 2) for c in range(10_000)}
    rows = [(i, 0 if i % 2 else rng.randrange(10_000), " ".join(rng.choice(words + ["법"]) for _ in range(6))) for i in range(12_000)]
    rows += [(50_000, None, "no catalog 법"), (50_001, 77_777, "unknown 법"), (50_002, 5, None)]
    nodes = spark.createDataFrame(rows, "n int, catalog int, text string").repartition(6)
    known = spark.createDataFrame([(c, t) for c, ts in titles.items() for t in ts] + [(None, "법"), (3, None)], "catalog int, title string")
    got = {r["n"]: (r["catalog"], [(c["start"], c["title"]) for c in r["candidates"]]) for r in extract.catalog_mentions(nodes, known, ["n"], group_nodes=1000, columns=("candidates",)).collect()}
    assert len(got) == len(rows)
    for n, catalog, text in rows:
        hits = extract.occurrences(text or "", d := extract.Dictionary.of(titles.get(catalog, [])))
        picked, unnamed, _ = extract.settled(text or "", hits, extract.MARKERS)
        assert got[n] == (catalog, sorted([(s, d.titles[t]) for t, s, _ in picked] + ([(unnamed, None)] if unnamed is not None else []), key=lambda c: c[0]))


def test_one_line_of_a_hundred_thousand_hits():
    """Work grows with the hits: all in one run of overlapping ones, and all apart."""
    import time

    began = time.perf_counter()
    for text, titles, n in (("ab" * 50_000 + "a", ["aba", "ab", "ba"], 25_000), ("a " * 100_000, ["a"], 100_000)):
        hits = extract.occurrences(text, extract.Dictionary.of(titles))
        selected, unnamed, matches = extract.settled(text, hits, ["z", "b"])
        assert len(selected) >= n and matches >= 100_000 and all(x[2] <= y[1] for x, y in zip(selected, selected[1:]))
    assert time.perf_counter() - began < 20


def test_empty_dictionary_null_text_and_no_nodes(spark):
    nodes = spark.createDataFrame([(1, None), (2, ""), (3, "법")], "n int, text string")
    none = spark.createDataFrame([], "title string")
    got = {r["n"]: [tuple(c) for c in r["candidates"]] for r in extract.mentions(nodes, none, ["n"]).collect()}
    assert got == {1: [], 2: [], 3: [(0, None, None)]}
    assert extract.mentions(nodes.where("n > 9"), none, ["n"]).count() == 0


def test_null_title_and_provision_resolve(spark):
    c = catalog_frames(spark, json.dumps(CATALOG).encode())
    refs = spark.createDataFrame([(None, None), ("모의장서기준", None), ("모의장서기준", "제12조"), ("모의장서기준", "제2조"), ("없는규정", "제1조")], "title string, provision string")
    want = {(None, None): "AMBIGUOUS_CITATION", ("모의장서기준", None): "PROVISION_MISMATCH", ("모의장서기준", "제12조"): "EXACT_CURRENT_MATCH", ("모의장서기준", "제2조"): "PROVISION_MISMATCH", ("없는규정", "제1조"): "CATALOG_NO_MATCH"}
    for found in (resolve.resolve(refs, c.versions, c.provisions, AS_OF), resolve.attach(refs, c.versions, c.provisions, AS_OF)):
        assert {(r["title"], r["provision"]): r["reason_code"] for r in found.collect()} == want
