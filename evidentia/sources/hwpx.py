"""HWPX documents (zipped XML) as text nodes; a document that breaks a rule gives one error row and no nodes.

One archive is one row of Spark's ``binaryFile`` source and is parsed by a table function over Arrow batches, so a folder of
documents is read by as many tasks as it has splits.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.errors import ARCHIVE_UNREADABLE, COLLECTION, LAYOUT_AMBIGUOUS
from evidentia.workers import ready

MIMETYPE = b"application/hwp+zip"
SECTION = re.compile(r"Contents/section([0-9]+)\.xml")


@dataclass(frozen=True)
class Limits:
    """The budgets of one document."""

    archive_bytes: int = 100 << 20
    entries: int = 10_000
    section_bytes: int = 20 << 20
    total_bytes: int = 200 << 20
    suffix_digits: int = 32
    elements: int = 200_000
    texts: int = 100_000
    depth: int = 128
    characters: int = 20 << 20


class Refused(Exception):
    def __init__(self, code: str, locator: str | None = None, message: str | None = None):
        super().__init__(code)
        self.code, self.locator, self.message = code, locator, message or COLLECTION[code]


def _plain(name: str) -> str:
    """A path without empty and ``.`` parts."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    return ("/" if name.startswith("/") else "") + "/".join(parts)


def section_entries(archive: zipfile.ZipFile, limits: Limits) -> list[zipfile.ZipInfo]:
    """The section entries in numeric order, once the whole directory is found in order."""
    entries = archive.infolist()
    if len(entries) > limits.entries or sum(e.file_size for e in entries) > limits.total_bytes:
        raise Refused("HWPX_LIMIT_EXCEEDED")
    names = [e.filename for e in entries]
    stored = all(e.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not e.flag_bits & 1 for e in entries)
    if not stored or len(set(names)) < len(names):
        raise Refused("DOCUMENT_NOT_ZIP")
    found: dict[tuple[int, str], zipfile.ZipInfo] = {}
    for e in entries:
        if m := SECTION.fullmatch(_plain(e.filename)):
            if len(m[1]) > limits.suffix_digits:
                raise Refused("HWPX_LIMIT_EXCEEDED")
            digits = m[1].lstrip("0") or "0"
            if found.setdefault((len(digits), digits), e) is not e:
                raise Refused("HWPX_XML_INVALID", message=LAYOUT_AMBIGUOUS)
    if any(e.file_size > limits.section_bytes for e in found.values()):
        raise Refused("HWPX_LIMIT_EXCEEDED")
    if names.count("mimetype") != 1:
        raise Refused("HWPX_MIMETYPE_INVALID")
    if not found:
        raise Refused("HWPX_SECTION_MISSING")
    return [found[k] for k in sorted(found)]


def _check_encoding(data: bytes, where: str) -> None:
    if b"\0" in data:
        raise Refused("HWPX_XML_INVALID", where)
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise Refused("HWPX_XML_INVALID", where) from None
    head = text[: text.find("?>") + 2] if text.startswith("<?xml") else ""
    named = re.search(r"""\bencoding\s*=\s*(?:"([^"']+)"|'([^"']+)')""", head, re.I)
    if named and (named[1] or named[2]).lower() not in ("utf-8", "utf8"):
        raise Refused("HWPX_XML_INVALID", where)
    if re.search("<!(?:DOCTYPE|ENTITY)", text, re.I):
        raise Refused("HWPX_XML_INVALID", where)


class Texts:
    """An expat handler that numbers ``t`` elements as they end and keeps what stands before their first child."""

    def __init__(self, limits: Limits):
        self.limits, self.elements, self.texts, self.characters = limits, 0, 0, 0

    def section(self, data: bytes, where: str) -> list[tuple[int, str]]:
        open_: list[list[str] | None] = []  # the direct text of open t elements; None for others
        whole: list[bool] = []  # whether a child has begun
        out: list[tuple[int, str]] = []
        ordinal = 0

        def start(tag: str, _: dict) -> None:
            self.elements += 1
            if whole:
                whole[-1] = True
            is_text = tag.rpartition("}")[2] == "t"
            self.texts += is_text
            open_.append([] if is_text else None)
            whole.append(False)
            if self.elements > self.limits.elements or self.texts > self.limits.texts or len(open_) > self.limits.depth:
                raise Refused("HWPX_LIMIT_EXCEEDED", where)

        def characters(text: str) -> None:
            if open_ and open_[-1] is not None and not whole[-1]:
                open_[-1].append(text)

        def end(_: str) -> None:
            nonlocal ordinal
            parts = open_.pop()
            whole.pop()
            if parts is not None:
                ordinal += 1
                text = "".join(parts)
                self.characters += len(text)
                if self.characters > self.limits.characters:
                    raise Refused("HWPX_LIMIT_EXCEEDED", where)
                if text:
                    out.append((ordinal, text))

        parser = expat.ParserCreate(namespace_separator="}")
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
        try:
            parser.Parse(data, True)
        except (expat.ExpatError, LookupError):
            raise Refused("HWPX_XML_INVALID", where) from None
        return out


def check_mimetype(archive: zipfile.ZipFile) -> None:
    with archive.open("mimetype") as f:
        if f.read(len(MIMETYPE) + 1) != MIMETYPE:
            raise Refused("HWPX_MIMETYPE_INVALID")


def section_texts(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, texts: Texts, limits: Limits) -> list[tuple[int, str]]:
    """(ordinal, text) of one section; ``texts`` counts what it uses."""
    with archive.open(entry) as f:
        data = f.read(limits.section_bytes + 1)
    if len(data) > limits.section_bytes:
        raise Refused("HWPX_LIMIT_EXCEEDED")
    _check_encoding(data, entry.filename)
    return texts.section(data, entry.filename)


def parse(content: bytes, limits: Limits = Limits()) -> tuple[list[tuple], Refused | None]:
    """([(section_rank, section_name, ordinal, text)], error) of one archive."""
    try:
        if len(content) > limits.archive_bytes:
            raise Refused("HWPX_LIMIT_EXCEEDED")
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            sections = section_entries(archive, limits)
            check_mimetype(archive)
            texts, rows = Texts(limits), []
            for rank, entry in enumerate(sections):
                rows += [(rank, entry.filename, n, t) for n, t in section_texts(archive, entry, texts, limits)]
            return rows, None
    except Refused as e:
        return [], e
    except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError, RuntimeError, UnicodeDecodeError, zlib.error):  # what zipfile, its streams and names raise on damage
        return [], Refused("DOCUMENT_NOT_ZIP", message=ARCHIVE_UNREADABLE)


#: Files up to this size are read, if only for their hash; larger ones, which no binary column could hold, are refused unread.
READ_BYTES = 1 << 30
PARSED = "path string, document_sha256 string, section_rank int, section_name string, ordinal int, locator string, text string, error_code string, error_locator string, error_message string"


def document_rows(path: str, content: bytes, limits: Limits = Limits()) -> list[tuple]:
    """Rows of one archive as in PARSED."""
    sha = hashlib.sha256(content).hexdigest()
    nodes, error = parse(content, limits)
    if nodes:
        return [(path, sha, r, s, n, f"{s}:t[{n}]", t, None, None, None) for r, s, n, t in nodes]
    return [(path, sha, None, None, None, None, None, *((error.code, error.locator, error.message) if error else (None, None, None)))]


def parse_documents(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of ``binaryFile`` (path, content) to text nodes or one error row each; a document without text gives one empty row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = document_rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), limits)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = [x.split()[0] for x in PARSED.split(", ")]
    arrow = pa.schema([(n, pa.int32() if n in ("section_rank", "ordinal") else pa.string()) for n in names])
    ready(files.sparkSession)
    if "length" not in files.columns:
        return files.select("path", "content").mapInArrow(run, PARSED)
    # the source reads no content of files that the filter on their length leaves out
    parsed = files.where(F.col("length") <= READ_BYTES).select("path", "content").mapInArrow(run, PARSED)
    told = {"path": F.col("path"), "error_code": F.lit("HWPX_LIMIT_EXCEEDED"), "error_message": F.lit(COLLECTION["HWPX_LIMIT_EXCEEDED"])}
    unread = files.where(F.col("length") > READ_BYTES).select(*(told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in parsed.schema))
    return parsed.unionByName(unread)


def read_documents(spark: SparkSession, folder: str, limits: Limits = Limits()) -> DataFrame:
    """All ``*.hwpx`` below a folder, parsed; archives beyond the size budget are refused, those beyond READ_BYTES unread and without a hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hwpx").option("recursiveFileLookup", "true").load(folder)
    return parse_documents(files, limits)


def archive(texts: list[str], section: str = "Contents/section0.xml") -> bytes:
    """A small document of one section, a text element each."""
    xml = '<?xml version="1.0" encoding="UTF-8"?><hs:section xmlns:hs="http://www.hancom.co.kr/hwpml/2011/paragraph">' + "".join(f"<hs:t>{escape(t)}</hs:t>" for t in texts) + "</hs:section>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", MIMETYPE)
        z.writestr(section, xml.encode())
    return out.getvalue()


def as_archives(documents: DataFrame) -> DataFrame:
    """(path, content) like ``binaryFile`` from (path, lines array<string>)."""

    def run(batches):
        for batch in batches:
            made = [archive(lines.as_py() or []) for lines in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    ready(documents.sparkSession)
    return documents.select("path", "lines").mapInArrow(run, "path string, content binary")


def bent_archives(documents: DataFrame) -> DataFrame:
    """(path, content) from (path, lines, bend): archives with one fault each, by number; 0 for none."""

    def bent(lines: list[str], bend: int) -> bytes:
        good = archive(lines)
        if bend == 0:
            return good
        if bend == 1:
            return b"no archive"
        if bend == 8:
            return good[: len(good) // 2]
        section = zipfile.ZipFile(io.BytesIO(good)).read("Contents/section0.xml")
        name = "Contents/sectionA.xml" if bend == 3 else "Contents/section0.xml"
        changed = {4: b"<!DOCTYPE x>" + section, 5: section + b"<open>", 6: section.replace(b"<hs:t>", b"<hs:t><b>", 1) if b"<hs:t>" in section else section + b"</b>", 7: section.replace(b"UTF-8", b"UTF-16", 1)}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            if bend != 9:
                z.writestr("mimetype", b"text/plain" if bend == 2 else MIMETYPE)
            z.writestr(name, changed.get(bend, section))
        return out.getvalue()

    def run(batches):
        for batch in batches:
            made = [bent(lines or [], bend) for lines, bend in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    ready(documents.sparkSession)
    return documents.select("path", "lines", "bend").mapInArrow(run, "path string, content binary")


def write_document(path, texts: list[str]) -> None:
    """One such document as a new file."""
    with open(path, "xb") as f:
        f.write(archive(texts))
