"""Folders of archives as a data source, ``spark.read.format("hwpx")``: partitions by the archives' own directories.

The planner reads file sizes and, of large archives, the directory: small archives are read many to a task, the sections of a
large one are dealt to several.  Sections of one archive share its budgets, so what they use travels with their rows and is
summed below one shuffle by document (``settled``), which gives the rows that ``hwpx.parse_documents`` gives.  The folder must be
mounted on every machine; for other stores there is ``hwpx.read_documents``.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from evidentia.errors import ARCHIVE_UNREADABLE, COLLECTION
from evidentia.sources import hwpx
from evidentia.workers import ready

#: Bytes, unpacked, from which a task reads no further archive, and from which the sections of one archive are dealt out.
SPLIT_BYTES = 16 << 20
SCHEMA = f"{hwpx.PARSED}, elements long, texts long, characters long"
NONE = (None,) * 3
DAMAGE = (zipfile.BadZipFile, EOFError, NotImplementedError, OSError, RuntimeError, UnicodeDecodeError, zlib.error)


@dataclass
class Archives(InputPartition):
    """Whole archives."""

    paths: list[str]


@dataclass
class Sections(InputPartition):
    """Some sections of one archive, by their ranks; the first such partition tells of the archive as a whole, too."""

    path: str
    ranks: list[int]
    first: bool


def uri(path: str) -> str:
    return f"file:{os.path.abspath(path)}"


class HwpxSource(DataSource):
    """Options: path (a folder), pattern (``*.hwpx``), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "hwpx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HwpxReader:
        return HwpxReader(self.options)


class HwpxReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.pattern, self.split = options.get("pattern", "*.hwpx"), int(options.get("splitBytes", SPLIT_BYTES))
        self.limits, self.wanted = hwpx.Limits(), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Archives that a filter on the path leaves out are not even planned."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                paths = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = paths if self.wanted is None else self.wanted & paths
            else:
                yield f

    def _files(self) -> Iterator[tuple[str, int]]:
        for folder, names, files in os.walk(self.folder):
            names.sort()
            for name in sorted(files):
                path = os.path.join(folder, name)
                if fnmatch(name, self.pattern) and (self.wanted is None or uri(path) in self.wanted):
                    yield path, os.path.getsize(path)

    def _groups(self, path: str) -> list[list[int]]:
        """Ranks of an archive's sections in groups of like size; none where it is to be read, or refused, as a whole."""
        try:
            with zipfile.ZipFile(path) as archive:
                sections = hwpx.section_entries(archive, self.limits)
        except (hwpx.Refused, *DAMAGE):
            return []
        groups, size = [[]], 0
        for rank, entry in enumerate(sections):
            if groups[-1] and size + entry.file_size > self.split:
                groups.append([])
                size = 0
            groups[-1].append(rank)
            size += entry.file_size
        return groups if len(groups) > 1 else []

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        small, size = [], 0
        for path, packed in self._files():
            # packing saves no more than this, so smaller ones need no look at their directory
            groups = self._groups(path) if self.limits.archive_bytes >= packed > self.split // 1024 else []
            if groups:
                out += [Sections(path, ranks, i == 0) for i, ranks in enumerate(groups)]
                continue
            small.append(path)
            size += packed + 4096
            if size >= self.split:
                out.append(Archives(small))
                small, size = [], 0
        return [*out, Archives(small)] if small or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._whole(partition) if isinstance(partition, Archives) else self._part(partition)

    def _whole(self, partition: Archives) -> Iterator[tuple]:
        for path in partition.paths:
            if os.path.getsize(path) > hwpx.READ_BYTES:
                yield uri(path), None, None, None, None, None, None, "HWPX_LIMIT_EXCEEDED", None, COLLECTION["HWPX_LIMIT_EXCEEDED"], *NONE
                continue
            with open(path, "rb") as f:
                content = f.read()
            for row in hwpx.document_rows(uri(path), content, self.limits):
                yield *row, *NONE

    def _part(self, partition: Sections) -> Iterator[tuple]:
        """Nodes, and of each section a row without a text that tells what it used and its error."""
        name = uri(partition.path)
        if partition.first:
            sha, error = hashlib.sha256(), NONE
            with open(partition.path, "rb") as f:
                while block := f.read(1 << 20):
                    sha.update(block)
            try:
                with zipfile.ZipFile(partition.path) as archive:
                    hwpx.check_mimetype(archive)
            except hwpx.Refused as e:
                error = (e.code, e.locator, e.message)
            except DAMAGE:
                error = ("DOCUMENT_NOT_ZIP", None, ARCHIVE_UNREADABLE)
            yield name, sha.hexdigest(), -1, None, None, None, None, *error, 0, 0, 0
        with zipfile.ZipFile(partition.path) as archive:
            entries = hwpx.section_entries(archive, self.limits)
            for rank in partition.ranks:
                texts, error, where = hwpx.Texts(self.limits), NONE, entries[rank].filename
                try:
                    for n, t in hwpx.section_texts(archive, entries[rank], texts, self.limits):
                        yield name, None, rank, where, n, f"{where}:t[{n}]", t, *NONE, *NONE
                except hwpx.Refused as e:
                    error = (e.code, e.locator, e.message)
                except DAMAGE:
                    error = ("DOCUMENT_NOT_ZIP", None, ARCHIVE_UNREADABLE)
                yield name, None, rank, where, None, None, None, *error, texts.elements, texts.texts, texts.characters


def settled(rows: DataFrame, limits: hwpx.Limits = hwpx.Limits()) -> DataFrame:
    """Rows of the source as those of ``hwpx.parse_documents``: the first section that errs or goes beyond a budget voids its archive.

    Archives that one task read as a whole pass as they are.  The sections of an archive meet below one shuffle by path, which a
    scan needs anyway; an archive's size is bounded.
    """
    columns = [c.split()[0] for c in hwpx.PARSED.split(", ")]
    part = F.col("section_rank") == -1
    document = Window.partitionBy("path")
    used = document.orderBy("section_rank", F.col("elements").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = (F.sum("elements").over(used) > limits.elements) | (F.sum("texts").over(used) > limits.texts) | (F.sum("characters").over(used) > limits.characters)
    split = rows.withColumn("split", F.coalesce(F.max(part).over(document), F.lit(False)))
    budgeted = split.withColumn("beyond", F.col("split") & F.col("elements").isNotNull() & beyond)
    code = F.when(F.col("beyond"), "HWPX_LIMIT_EXCEEDED").otherwise(F.col("error_code"))
    fault = F.struct("section_rank", code.alias("code"), F.when(F.col("beyond"), F.col("section_name")).otherwise(F.col("error_locator")).alias("locator"), F.when(F.col("beyond"), COLLECTION["HWPX_LIMIT_EXCEEDED"]).otherwise(F.col("error_message")).alias("message"))
    told = budgeted.withColumns({"fault": F.min(F.when(F.col("split") & (F.col("beyond") | F.col("error_code").isNotNull()), fault)).over(document), "sha": F.max("document_sha256").over(document), "filled": F.count("text").over(document)})
    # of a split archive stay its nodes, or one row that tells the fault, or that there is no text
    kept = told.where(~F.col("split") | (F.col("fault").isNull() & F.col("text").isNotNull()) | (part & (F.col("fault").isNotNull() | (F.col("filled") == 0))))
    bare = F.col("split") & F.col("text").isNull()
    fill = {"document_sha256": F.coalesce("document_sha256", "sha"), "section_rank": F.when(~bare, F.col("section_rank")), "error_code": F.when(bare, F.col("fault.code")).otherwise(F.col("error_code")), "error_locator": F.when(bare, F.col("fault.locator")).otherwise(F.col("error_locator")), "error_message": F.when(bare, F.col("fault.message")).otherwise(F.col("error_message"))}
    return kept.select(*(fill.get(c, F.col(c)).alias(c) for c in columns))


def raw_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The source's rows as they come."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HwpxSource)
    return spark.read.format("hwpx").options(**options).load(folder)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All archives below a folder, as ``hwpx.parse_documents`` gives them."""
    return settled(raw_archives(spark, folder, **options))
