"""Lines of files that grow, as a streaming source.

The offset holds, for each file, the end of its last complete line and a fingerprint of
its first line. A batch reads from the old end to the new one; where the fingerprint
changed or the file is shorter than what was read, it reads from the start again and says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from meterlight.sources.lines import LONGEST_LINE, entities

#: Longest first line, in bytes: a file with a longer one isn't read.
FIRST_LINE = 64 << 10
#: Bytes that one task reads; bytes read at once.
PART_BYTES, PIECE = 64 << 20, 1 << 20
SCHEMA = "path string, at long, value string, fresh boolean"


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    low: int
    high: int
    end: int
    fingerprint: str
    fresh: bool


def opened(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def fingerprint(file) -> str | None:
    """Of the first line; None if it isn't complete or is too long."""
    file.seek(0)
    start = file.read(FIRST_LINE + 2)
    cut = start.find(b"\n")
    line = start[:cut].removesuffix(b"\r")
    return hashlib.sha256(line).hexdigest() if cut >= 0 and len(line) <= FIRST_LINE else None


def state(path: str, size: int) -> tuple[int, str] | None:
    """(end of the last complete line, fingerprint); None for a file that can't be read yet or is gone."""
    try:
        with opened(path) as file:
            known = fingerprint(file)
            end = min(size, file.size())
            while known and end > 0:
                low = max(0, end - PIECE)
                file.seek(low)
                cut = file.read(end - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1, known
                end = low
    except FileNotFoundError:
        pass
    return None


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, inner = pyarrow.fs.FileSystem.from_uri(self.folder)
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        stamps = {scheme + f.path: (f.size, f.mtime_ns) for f in found}
        fresh = [p for p, stamp in stamps.items() if self.seen.get(p, (None,))[0] != stamp]
        with ThreadPoolExecutor(16) as pool:
            self.seen |= {p: (stamps[p], s) for p, s in zip(fresh, pool.map(lambda p: state(p, stamps[p][0]), fresh))}
        self.seen = {p: self.seen[p] for p in sorted(stamps)}
        return {p: list(s) for p, (_, s) in self.seen.items() if s}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for path, (high, known) in end.items():
            low, before = start.get(path, (0, None))
            fresh = before != known or high < low
            begin = 0 if fresh else low
            for at in range(begin, high, PART_BYTES):
                parts.append(Part(path, begin, at, min(high, at + PART_BYTES), high, known, fresh))
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        """Lines that begin inside the part. A file that was changed since then gives none: the
        next offset has its new fingerprint or size, and reads it afresh."""
        try:
            file = opened(part.path)
        except FileNotFoundError:
            return
        with file:
            if fingerprint(file) != part.fingerprint or file.size() < part.end:
                return
            at, rest, skip = part.low, b"", part.low > part.begin
            file.seek(part.low - skip)
            at -= skip
            # A part after the first begins behind the first line end at or after the byte before it.
            while at < part.high or rest:
                piece = file.read(min(PIECE, part.end - file.tell()))
                if not piece:
                    return
                rest += piece
                *lines, rest = rest.split(b"\n")
                for line in lines:
                    if not skip:
                        if at >= part.high:
                            return
                        if len(line) <= LONGEST_LINE:
                            yield part.path, at, line.removesuffix(b"\r").decode("utf-8", "replace"), part.fresh
                    skip = False
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Options: path, a folder or URI that pyarrow's file systems can open; suffix."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", ".jsonl"))


def grown_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """The stream (path, at, value, fresh) of complete lines below a folder: ``at`` is a
    line's first byte; ``fresh`` lines void what was read of their file before. Overlong
    lines, and files whose first line is, stay out."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", folder).option("suffix", suffix).load()


def current_lines(read: DataFrame, arrival: str) -> DataFrame:
    """(entity, path, line, value): what files hold now, given all lines read of them. Numbers
    count from 1 by place."""
    since = F.max(F.when(F.col("fresh"), F.col(arrival))).over(Window.partitionBy("path"))
    now = read.withColumn("__since", since).where(F.col(arrival) >= F.col("__since"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("at")).cast("bigint")
    return entities(now.withColumn("line", number)).select("entity", "path", "line", "value")
