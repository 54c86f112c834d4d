"""A sink that makes one text file of many tasks' lines: all of it, or nothing.

``lines.write.format("report").mode("overwrite").save(path)`` after
``spark.dataSource.register(ReportSink)``. Each task writes its lines to a file of its own beside
the target; the commit joins these files in the order of the partitions, syncs, and takes the
name; after a failure they are removed and the target stays as it was. Lines pass the driver
in blocks of a copy, never as rows. The target is on a file system that tasks and driver share.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    file: str
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        # made here only: a task that outlives its job finds no folder to write to
        os.makedirs(self.parts)

    def write(self, iterator: Iterator[Row]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        # an attempt that is lost leaves a file that no message names
        name = os.path.join(self.parts, f"{task.partitionId()}-{task.taskAttemptId()}")
        with open(name, "w", encoding="utf-8") as fh:
            for row in iterator:
                fh.write(row["line"] + "\n")
            fh.flush()
            os.fsync(fh.fileno())
        return _Part(task.partitionId(), name, os.path.getsize(name))

    def commit(self, messages: list[_Part | None]) -> None:
        whole = os.path.join(self.parts, "whole")
        try:
            own = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
            with open(whole, "wb") as out:
                for m in own:
                    with open(m.file, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                out.flush()
                os.fsync(out.fileno())
            if os.path.getsize(whole) != sum(m.size for m in own):
                raise OSError(f"{self.path}: what was written differs")
            os.replace(whole, self.path)
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[_Part | None]) -> None:
        # a task may be writing yet
        for _ in range(20):
            shutil.rmtree(self.parts, ignore_errors=True)
            if not os.path.exists(self.parts):
                return
            time.sleep(0.1)


class ReportSink(DataSource):
    """Takes rows with a column ``line``."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a report is written as a whole: use mode overwrite")
        if "line" not in schema.names:
            raise ValueError("a report is made of a column named line")
        return _Writer(self.options["path"])


def save_report(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes the column ``line`` of ``lines`` by ``order``; ranges of the order are tasks."""
    lines.sparkSession.dataSource.register(ReportSink)
    lines.orderBy(*order).select("line").write.format("report").mode("overwrite").save(path)
