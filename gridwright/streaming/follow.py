"""Following logs with Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def follow_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of files that appear in a folder, with the file they came from.

    Spark's file source takes each file once, when it is there: logs are to be rotated into the folder whole.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def count_by_window(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each kind in each window; windows close once ``late`` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


class _GrowingFile(DataSource):
    """Lines appended to one file. A line counts once its break is there; a replaced or shrunk file is read from its start."""

    @classmethod
    def name(cls) -> str:
        return "growing_file"

    def schema(self) -> str:
        return "line string, position bigint"

    def streamReader(self, schema):
        return _GrowingFileReader(self.options["path"], int(self.options.get("bytes_per_task", 128 << 20)))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _GrowingFileReader(DataSourceStreamReader):
    """Offsets are {inode, bytes}: all lines that begin before ``bytes`` are out. A task reads those that begin in its range."""

    def __init__(self, path: str, bytes_per_task: int):
        self.path, self.bytes_per_task = path, bytes_per_task

    def initialOffset(self) -> dict:
        return {"inode": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        try:
            with open(self.path, "rb") as f:
                return {"inode": os.fstat(f.fileno()).st_ino, "bytes": _last_break(f, os.fstat(f.fileno()).st_size)}
        except FileNotFoundError:
            return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low = start["bytes"] if start["inode"] == end["inode"] and start["bytes"] <= end["bytes"] else 0
        return [_Range(k, min(k + self.bytes_per_task, end["bytes"])) for k in range(low, end["bytes"], self.bytes_per_task)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(max(0, partition.low - 1))
            if partition.low:
                f.readline()  # the rest of the line that began before
            while (at := f.tell()) < partition.high:
                yield f.readline().decode("utf-8", "replace").rstrip("\r\n"), at


def _last_break(f, size: int, block: int = 1 << 16) -> int:
    """The position after the last line break before ``size``, looked for from the end."""
    high = size
    while high:
        low = max(0, high - block)
        f.seek(low)
        at = f.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


def follow_file(spark: SparkSession, path: str, bytes_per_task: int = 128 << 20) -> DataFrame:
    """(line, position) of the complete lines of one file that grows, in a folder that all executors see.

    After a restart from the stream's checkpoint only what is new is read, in tasks of ``bytes_per_task``.
    """
    spark.dataSource.register(_GrowingFile)
    return spark.readStream.format("growing_file").option("path", path).option("bytes_per_task", bytes_per_task).load()
