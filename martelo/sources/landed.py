"""Landed gazette responses as a Python data source: spark.read.format("gazette_pages").load(path), or readStream.

Responses lie at <path>/term=<term>/day=<day>/page=<n>/<files>, each file one JSON text: what a search for a term on a
day answered, page by page. A task reads one term and day: pages from 1 on, until one has fewer than page_size items
(items as the response counts them, whether they can be used or not), is missing, or is the last of max_pages. Rows
hold the raw bodies, `files.gazette` makes publications of them.

Filters on term and day choose the tasks, so that other folders are not even listed; Spark passes them on where
spark.sql.python.filterPushdown.enabled is set. As a stream, offsets are days: a batch holds the days after the last
one, up to the latest that has landed, so a day's pages must land together (by renaming its folder into place).

Files are opened by Arrow's file systems (local, hdfs, s3).

Options: page_size (100), max_pages (10), days (no bound) with as_of: only days from as_of - days to as_of.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .files import ENVELOPES

FORMAT = "gazette_pages"
SCHEMA = "term string, day date, page int, value string"


class _Search(InputPartition):
    """One term and day, and the pages to read of it."""

    def __init__(self, term: str, day: dt.date, folder: str):
        super().__init__(f"{term}/{day}")
        self.term, self.day, self.folder = term, day, folder


def items_in(body: str) -> int:
    """How many items a response tells of; one that can't be read has none."""
    try:
        made = json.loads(body)
    except ValueError:
        return 0
    if isinstance(made, dict):
        made = next((made[e] for e in ENVELOPES if isinstance(made.get(e), list)), [])
    return len(made) if isinstance(made, list) else 0


class _Folders:
    """The tree of landed responses."""

    def __init__(self, path: str, options: dict):
        self.path = path
        self.page_size, self.max_pages = int(options.get("page_size", 100)), int(options.get("max_pages", 10))
        days, as_of = options.get("days"), options.get("as_of")
        if (days is None) != (as_of is None):
            raise ValueError("days and as_of go together")
        self.last = dt.date.fromisoformat(as_of) if as_of else None
        self.first = self.last - dt.timedelta(days=int(days)) if days else None

    def _named(self, system, folder: str, name: str) -> Iterator[tuple[str, str]]:
        """(value, path) of the folders <name>=<value> in a folder, by paths as the file system has them."""
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            key, _, value = info.base_name.partition("=")
            if info.type == fs.FileType.Directory and key == name:
                yield unquote(value), info.path

    def searches(self, keep) -> list[_Search]:
        """The terms and days that `keep` takes, within the window."""
        found = []
        system, root = fs.FileSystem.from_uri(self.path)
        for term, folder in self._named(system, root, "term"):
            if not keep(term, None):
                continue
            for text, at in self._named(system, folder, "day"):
                day = dt.date.fromisoformat(text)
                if (self.first is None or self.first <= day) and (self.last is None or day <= self.last) and keep(term, day):
                    found.append(_Search(term, day, at))
        return sorted(found, key=lambda s: (s.term, s.day))

    def days(self) -> set[dt.date]:
        return {s.day for s in self.searches(lambda term, day: True)}

    def read(self, search: _Search | None) -> Iterator[tuple]:
        if search is None:  # what Spark makes of no partitions
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        pages = {int(n): at for n, at in self._named(system, search.folder, "page")}
        for page in range(1, self.max_pages + 1):
            if page not in pages:
                return
            n = 0
            for info in sorted(system.get_file_info(fs.FileSelector(pages[page])), key=lambda i: i.path):
                if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                    with system.open_input_stream(info.path) as file:
                        body = file.read().decode()
                    n += items_in(body)
                    yield search.term, search.day, page, body
            if n < self.page_size:
                return


TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class _Reader(DataSourceReader):
    def __init__(self, folders: _Folders):
        self.folders, self.tests = folders, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of term and day with values are met by the choice of folders; the rest is left to Spark."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("term",), ("day",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _keep(self, term: str, day: dt.date | None) -> bool:
        own = {"term": term, "day": day}
        return all(own[name] is None or TESTS[kind](own[name], value) for name, kind, value in self.tests)

    def partitions(self) -> list[_Search]:
        return self.folders.searches(self._keep)

    def read(self, partition: _Search) -> Iterator[tuple]:
        return self.folders.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folders: _Folders):
        self.folders = folders

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": max((d.isoformat() for d in self.folders.days()), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Search]:
        return self.folders.searches(lambda term, day: day is None or start["day"] < day.isoformat() <= end["day"])

    def read(self, partition: _Search) -> Iterator[tuple]:
        return self.folders.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go: landed files stay until their retention ends."""


class GazettePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _folders(self) -> _Folders:
        if "path" not in self.options:
            raise ValueError("gazette_pages needs a path")
        return _Folders(self.options["path"].rstrip("/"), self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._folders())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._folders())


def pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The landed pages as a table; Spark passes filters on to the source."""
    spark.dataSource.register(GazettePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**options).load(path)


def page_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(GazettePages)
    return spark.readStream.format(FORMAT).options(**options).load(path)


def land(responses: DataFrame, path: str) -> None:
    """Write responses (term, day, page, value) where the source reads them."""
    responses.select("term", "day", "page", "value").write.mode("append").partitionBy("term", "day", "page").text(path)
