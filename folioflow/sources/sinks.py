"""What executors write: files by name, and one text file of ordered lines.

Both are Python data sources. A task writes under names of its own attempt; what it wrote counts only when Spark commits
the job, and is removed when Spark aborts it, so that a killed task leaves no half file. The folder must be one that driver and
executors share.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """A staged file or folder, and the number of its first line."""

    path: str
    first: int = 0


def _gone(folder: str) -> None:
    """Remove a staging folder, also while tasks that are being killed still write there; they cannot make it anew."""
    for _ in range(50):
        shutil.rmtree(folder, ignore_errors=True)
        if not os.path.exists(folder):
            return
        time.sleep(0.1)


class FileSink(DataSource):
    """``df.write.format("named_files").save(folder)`` of rows (name, text): a file each."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staged = folder, f"{folder}/.staged-{uuid.uuid4().hex}"
        os.mkdir(self.staged)  # by the driver; tasks only make folders and files inside

    def write(self, rows: Iterator[Row]) -> Written:
        own = f"{self.staged}/{uuid.uuid4().hex}"
        os.mkdir(own)
        for row in rows:
            with open(f"{own}/{row['name']}", "w", encoding="utf-8", newline="") as out:
                out.write(row["text"] or "")
        return Written(own)

    def commit(self, messages: list) -> None:
        for message in filter(None, messages):
            for name in os.listdir(message.path):
                os.replace(f"{message.path}/{name}", f"{self.folder}/{name}")
        _gone(self.staged)

    def abort(self, messages: list) -> None:
        _gone(self.staged)


class LineSink(DataSource):
    """``df.write.format("ordered_lines").save(file)`` of rows (line_no, line), whose partitions are ranges in order: one text file."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


class LineWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staged = path, f"{path}.staged-{uuid.uuid4().hex}"
        os.mkdir(self.staged)

    def write(self, rows: Iterator[Row]) -> Written | None:
        own, first = f"{self.staged}/{uuid.uuid4().hex}", None
        with open(own, "w", encoding="utf-8", newline="") as out:
            for row in rows:
                first = row["line_no"] if first is None else first
                out.write(f"{row['line']}\n")
        return Written(own, -1 if first is None else first)

    def commit(self, messages: list) -> None:
        # Parts are joined piece by piece into a file that takes its name when it is whole.
        whole = f"{self.staged}/whole"
        with open(whole, "wb") as out:
            for message in sorted(filter(None, messages), key=lambda m: m.first):
                with open(message.path, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
        os.replace(whole, self.path)
        _gone(self.staged)

    def abort(self, messages: list) -> None:
        _gone(self.staged)


def register(spark: SparkSession) -> None:
    for sink in (FileSink, LineSink):
        spark.dataSource.register(sink)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (name, text) as files of a folder that is there; executors write them."""
    register(rows.sparkSession)
    rows.select("name", "text").write.format("named_files").mode("append").save(folder)


def write_lines(rows: DataFrame, path: str) -> None:
    """Write ``rows`` (line_no, line) as one text file, in the order of line_no; executors write its parts."""
    register(rows.sparkSession)
    dealt = rows.select("line_no", "line").repartitionByRange("line_no").sortWithinPartitions("line_no")
    dealt.write.format("ordered_lines").mode("append").save(path)
