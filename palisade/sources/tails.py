"""Logs that grow: one append-only file read by byte ranges, as a table or as a stream that goes on where it stopped.

The engine's file streams take whole new files; a log is one file to which lines are added. A range of the file belongs to
the task in whose range a line begins, so lines are read once whatever the cuts. What comes after the last line feed is
not a line yet: a stream waits for its end, a table leaves it out. A file that got shorter than the offset was replaced,
which is an error and not a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palisade.sources.package import ship
from palisade.sources.reports import opened

FORMAT, RANGE_BYTES, BLOCK, BATCH = "growing_log", 64 << 20, 1 << 20, 8192


@dataclass
class Range(InputPartition):
    start: int
    end: int


def complete(path: str) -> int:
    """The offset behind the last line feed; 0 if there is no file or no line."""
    files, at = opened(path)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return 0
    with files.open_input_file(at) as raw:
        end = raw.size()
        while end > 0:
            start = max(0, end - BLOCK)
            found = raw.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def ranges(start: int, end: int, size: int) -> list[Range]:
    return [Range(a, min(a + size, end)) for a in range(start, end, size)] or [Range(end, end)]


def lines_of(path: str, part: Range, end_of_log: int) -> Iterator[pa.RecordBatch]:
    """(offset, line) of the lines that begin in a range; a range that begins at 0 or behind a line feed begins a line."""
    if part.start >= part.end:
        return
    files, at = opened(path)
    with files.open_input_file(at) as raw:
        if raw.size() < end_of_log:
            raise ValueError(f"{path} has {raw.size()} bytes and had {end_of_log}")
        position = part.start
        skip = position > 0 and raw.read_at(1, position - 1) != b"\n"
        held, begins, offsets, texts = [], position, [], []
        while position < end_of_log and (begins < part.end):
            block = raw.read_at(min(BLOCK, end_of_log - position), position)
            position += len(block)
            *ended, rest = block.split(b"\n")
            for piece in ended:
                held.append(piece)
                line, length = b"".join(held), sum(map(len, held)) + 1
                if begins >= part.end:
                    break
                if not skip:
                    offsets.append(begins)
                    texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                begins, held, skip = begins + length, [], False
                if len(offsets) == BATCH:
                    yield _batch(offsets, texts)
                    offsets, texts = [], []
            if rest:
                held.append(rest)
        if offsets:
            yield _batch(offsets, texts)


def _batch(offsets: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["offset", "line"])


class TableReader(DataSourceReader):
    def __init__(self, path: str, since: int, size: int):
        self.path, self.since, self.size = path, since, size
        self.end = complete(path)

    def partitions(self) -> list[Range]:
        return ranges(min(self.since, self.end), self.end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition, self.end)


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        return {"bytes": complete(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["bytes"] < start["bytes"]:
            raise ValueError(f"{self.path} has {end['bytes']} bytes of lines and had {start['bytes']}")
        return [Ended(r.start, r.end, end["bytes"]) for r in ranges(start["bytes"], end["bytes"], self.size)]

    def read(self, partition: Ended) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition, partition.log_end)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Ended(Range):
    log_end: int


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], int(self.options.get("since", 0)), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogSource)


def table(spark: SparkSession, path: str, since: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(offset, line) of the log's whole lines that begin at byte `since` or later."""
    register(spark)
    return spark.read.format(FORMAT).options(path=path, since=since, rangeBytes=range_bytes).load()


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(offset, line) as a stream: each line once, over restarts from the query's checkpoint."""
    register(spark)
    return spark.readStream.format(FORMAT).options(path=path, rangeBytes=range_bytes).load()
