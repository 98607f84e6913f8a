"""A sink of one file a row, all or none: ``frame.write.format("committed").option("path", folder).mode("append").save()``.

Rows are (name, content).  Tasks write under a hidden folder of the job; the driver puts the files in their places once all
tasks are done, refuses to replace any that is there, and takes back what it has placed if it cannot place all.  A task that is
run again writes anew, and only what the job counts is placed.  The folder must be mounted on every machine.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from evidentia.errors import OUTPUT_EXISTS, EvidenceError
from evidentia.workers import ready

@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: names by their temporary files."""

    files: dict[str, str]


class CommittedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise EvidenceError("REVIEW_OUTPUT_EXISTS", "Files are never replaced; use the mode append.")
        return CommittedWriter(self.options["path"], schema.names)


class CommittedWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.folder = path.removeprefix("file://").removeprefix("file:")
        self.job = os.path.join(self.folder, f".job-{uuid.uuid4().hex}")
        self.name, self.content = names.index("name"), names.index("content")
        os.makedirs(self.folder, exist_ok=True)
        os.mkdir(self.job)  # here and nowhere else: a task that outlives the job finds no place to write

    def write(self, rows: Iterator) -> Written:
        task = os.path.join(self.job, uuid.uuid4().hex)
        os.mkdir(task)
        files: dict[str, str] = {}
        for n, row in enumerate(rows):
            name, content = row[self.name], row[self.content]
            if not name or os.path.basename(name) != name or name.startswith(".") or name in files:
                raise EvidenceError("REVIEW_PATH_INVALID", "Output names are plain, and each is written once.")
            files[name] = os.path.join(task, str(n))
            with open(files[name], "xb") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
                f.flush()
                os.fsync(f.fileno())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        placed: list[str] = []
        try:
            for message in messages:
                for name, temporary in (message.files if message else {}).items():
                    final = os.path.join(self.folder, name)
                    os.link(temporary, final)  # fails where the name is taken
                    placed.append(final)
        except FileExistsError:
            self._take_back(placed)
            raise EvidenceError(*OUTPUT_EXISTS) from None
        except OSError:
            self._take_back(placed)
            raise EvidenceError("REVIEW_OUTPUT_FAILED", "Output could not be written.", 1) from None
        self._clear()

    def _clear(self) -> None:
        for _ in range(100):  # a task may still write while its folder goes
            shutil.rmtree(self.job, ignore_errors=True)
            if not os.path.exists(self.job):
                return
            time.sleep(0.05)

    def _take_back(self, placed: list[str]) -> None:
        for path in placed:
            os.unlink(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(CommittedFiles)


def save(rows: DataFrame, folder: str, name: Column, content: Column) -> None:
    """Each row as a file of the folder: all of them, or none and an error.  Pages, reports as JSON and ledgers alike."""
    register(rows.sparkSession)
    rows.select(name.alias("name"), content.cast("binary").alias("content")).write.format("committed").option("path", folder).mode("append").save()
