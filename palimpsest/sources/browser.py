"""Browser histories as a Python data source: batch and micro-batch reads with a cursor for each browser."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_DDL = "browser string, visit_id long, url string, title string, visited_at timestamp"
#: The tables of either kind of history file, and the year from which its microseconds count.
QUERIES = {
    "chrome": ("SELECT v.id, u.url, u.title, v.visit_time FROM visits v JOIN urls u ON v.url = u.id WHERE v.id > ? AND v.id <= ? AND u.url LIKE 'http%' ORDER BY v.id", "SELECT max(id) FROM visits", 1601),
    "firefox": ("SELECT id, url, title, last_visit_date FROM moz_places WHERE id > ? AND id <= ? AND url LIKE 'http%' ORDER BY id", "SELECT max(id) FROM moz_places", 1970),
}
ROWS = 50_000  #: ids that one task reads


def _opened(path: str) -> sqlite3.Connection:
    """The file as it is on disk, whether or not the browser that writes it holds a lock."""
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro&immutable=1", uri=True)


class _Part(InputPartition):
    """Visits of a browser with ids over `after`, up to `last`."""

    def __init__(self, browser: str, path: str, after: int, last: int) -> None:
        super().__init__((browser, path, after, last))
        self.browser, self.path, self.after, self.last = browser, path, after, last


def _last_id(browser: str, path: str) -> int:
    if not os.path.exists(path):
        return 0
    connection = _opened(path)
    try:
        return connection.execute(QUERIES[browser][1]).fetchone()[0] or 0
    finally:
        connection.close()


def _parts(browser: str, path: str, after: int, last: int) -> list[_Part]:
    return [_Part(browser, path, a, min(a + ROWS, last)) for a in range(after, last, ROWS)]


def _read(part: _Part) -> Iterator[tuple]:
    connection = _opened(part.path)
    try:
        start = datetime(QUERIES[part.browser][2], 1, 1, tzinfo=UTC)
        for visit, url, title, time in connection.execute(QUERIES[part.browser][0], (part.after, part.last)):
            yield part.browser, visit, url, title or "", None if time is None else start + timedelta(microseconds=time)
    finally:
        connection.close()


class _Reader(DataSourceReader):
    def __init__(self, paths: dict[str, str], after: dict[str, int]) -> None:
        self.paths, self.after = paths, after

    def partitions(self) -> list[_Part]:
        return [p for b, path in self.paths.items() for p in _parts(b, path, self.after.get(b, 0), _last_id(b, path))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the last id read of each browser, so that one's ids never hide another's; a file that was begun anew is read from its start."""

    def __init__(self, paths: dict[str, str], after: dict[str, int]) -> None:
        self.paths, self.after = paths, after

    def initialOffset(self) -> dict:
        return {b: self.after.get(b, 0) for b in self.paths}

    def latestOffset(self) -> dict:
        return {b: _last_id(b, path) for b, path in self.paths.items()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        spans = ((b, path, start.get(b, 0), end.get(b, 0)) for b, path in self.paths.items())
        return [p for b, path, a, z in spans for p in _parts(b, path, 0 if z < a else a, z)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        pass


class BrowserHistorySource(DataSource):
    """format("browser_history"); options chrome and firefox: paths of the history files, on the node where the browsers run;
    chrome_after and firefox_after: the ids after which to begin."""

    @classmethod
    def name(cls) -> str:
        return "browser_history"

    def schema(self) -> str:
        return _DDL

    def _asked(self) -> tuple[dict[str, str], dict[str, int]]:
        return {b: self.options[b] for b in QUERIES if self.options.get(b)}, {b: int(self.options.get(f"{b}_after", 0)) for b in QUERIES}

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._asked())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._asked())
