"""A shell-history tail as a Python data source: batch and micro-batch reads by byte offset."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_DDL = "path string, history string"


class _Part(InputPartition):
    """Bytes start to end of a file; end None: to its end."""

    def __init__(self, path: str, start: int = 0, end: int | None = None) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _read(part: _Part) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        f.seek(part.start)
        yield part.path, f.read(-1 if part.end is None else part.end - part.start).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _read(partition)


def _whole_lines(path: str, start: int) -> int:
    """The end of the last whole line of a file, found from its end in small steps; start where there is none after it."""
    at = os.path.getsize(path)
    with open(path, "rb") as f:
        while at > start:
            low = max(start, at - 4096)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class _Tail(DataSourceStreamReader):
    """Offsets are bytes per file at ends of lines, so no command is torn; a file that shrank is read from its start. Only offsets are made in the driver, tasks read the bytes."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.paths, 0)

    def latestOffset(self) -> dict:
        return {p: _whole_lines(p, 0) if os.path.exists(p) else 0 for p in self.paths}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        spans = [(p, 0 if end.get(p, 0) < start.get(p, 0) else start.get(p, 0), end.get(p, 0)) for p in self.paths]
        return [_Part(p, a, b) for p, a, b in spans if b > a]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        pass


class HistorySource(DataSource):
    """format("shell_history"), option paths: comma-separated files on the node where the shell runs."""

    @classmethod
    def name(cls) -> str:
        return "shell_history"

    def schema(self) -> str:
        return _DDL

    def _paths(self) -> list[str]:
        return [p for p in self.options.get("paths", "").split(",") if p]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Tail(self._paths())
