"""A data source of pages: records that a service lists newest first, a page at a time.

A page is an object ``{"total": n, "rows": [...]}``; ``FolderPages`` reads pages as
files ``page-<n>.json`` of a folder, and another service is another ``fetch``. In a
batch a partition is a page or, of many, a run of pages, whose places the driver
finds once. A filter on the date that asks for what is not
older than a day is turned into the last page to read, found by looking at the
newest rows of log2(pages) pages; pages behind it are never read. As a stream, the
offset is the number of records listed so far: as new ones come first, what is
new stands before what has been read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from tallystone.sources.folders import content, files_below, opened

#: Rows of a list, as text; whoever reads them casts.
SCHEMA = "id string, title string, date string, status string"
MAX_PAGES = 1_000_000
#: Partitions at most; of more pages, a partition is a run.
PARTITIONS = 400


class FolderPages:
    """Pages as JSON files in a folder or in folders below it; a page beyond the first that is not there is empty."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.places: dict[str, str] = {}

    def found(self) -> dict[str, str]:
        """Places of all pages by their names."""
        before = opened(self.path)[2]
        return {f.path.rsplit("/", 1)[-1]: before + f.path for f in files_below(self.path, (".json",))}

    def fetch(self, page: int) -> dict:
        name = f"page-{page}.json"
        try:
            try:
                return json.loads(content(f"{self.path}/{name}"))
            except FileNotFoundError:
                if not self.places:
                    self.places = self.found()
                if name not in self.places:
                    raise
                return json.loads(content(self.places[name]))
        except FileNotFoundError:
            if page == 1:
                raise
            return {"total": 0, "rows": []}


@dataclass
class Page(InputPartition):
    """A page, or a run of pages up to the last one, and where they are, if the driver had to look for them."""

    number: int
    last: int
    places: dict[str, str] = field(default_factory=dict)


@dataclass
class Span(InputPartition):
    """Records by their distance from the oldest one, which new arrivals do not change."""

    start: int
    end: int


def newest(rows: list[dict]) -> str:
    return str((rows[0] if rows else {}).get("date") or "")


def last_page(pages: FolderPages, n_pages: int, since: str) -> int:
    """The last page whose newest record is not older than ``since``; 0 if there is none. Pages are sorted by date, newest first."""
    low, high = 0, n_pages
    while low < high:
        middle = (low + high + 1) // 2
        if newest(pages.fetch(middle)["rows"]) >= since:
            low = middle
        else:
            high = middle - 1
    return low


def batch_of(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    """Rows as text; what is missing is null."""
    texts = lambda n: [None if r.get(n) is None else str(r[n]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(texts(n), pa.string()) for n in names], names)


class PageReader(DataSourceReader):
    def __init__(self, pages: FolderPages, schema: StructType, options: dict[str, str]):
        self.pages, self.names = pages, schema.fieldNames()
        self.since: str | None = None
        self.cap = int(options.get("max_pages", MAX_PAGES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            # The filter is also left to Spark: a page holds older rows, too.
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("date",):
                self.since = max(self.since or "", str(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        first = self.pages.fetch(1)
        size = len(first["rows"])
        n = min(self.cap, math.ceil(first["total"] / size)) if size else 0
        if self.since is not None:
            n = last_page(self.pages, n, self.since)
        step = max(1, math.ceil(n / PARTITIONS))
        places, self.pages.places = getattr(self.pages, "places", {}), {}
        held = lambda a, b: {k: places[k] for k in (f"page-{i}.json" for i in range(a, b + 1)) if k in places}
        runs = [(a, min(n, a + step - 1)) for a in range(1, n + 1, step)]
        return [Page(a, b, held(a, b)) for a, b in runs] or [Page(1, 0)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        self.pages.places = dict(partition.places)
        for page in range(partition.number, partition.last + 1):
            yield batch_of(self.pages.fetch(page)["rows"], self.names)


class PageStream(DataSourceStreamReader):
    """Offsets are numbers of records listed; a partition is a page's worth of records or, of many, several pages', found anew when it is read."""

    def __init__(self, pages: FolderPages, schema: StructType):
        self.pages, self.names = pages, schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        return {"n": self.pages.fetch(1)["total"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        size = max(1, len(self.pages.fetch(1)["rows"]))
        size *= max(1, math.ceil((end["n"] - start["n"]) / size / PARTITIONS))
        return [Span(a, min(a + size, end["n"])) for a in range(start["n"], end["n"], size)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.end > partition.start:
            first = self.pages.fetch(1)
            size, total = len(first["rows"]), first["total"]
            a, b = total - partition.end, total - partition.start  # places from the newest record
            for p in range(a // size, -(-b // size)):
                rows = (first if p == 0 else self.pages.fetch(p + 1))["rows"][max(0, a - p * size) : b - p * size]
                yield from (tuple(None if r.get(n) is None else str(r[n]) for n in self.names) for r in rows)

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """Options: path (by load), max_pages."""

    pages = FolderPages

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.pages(dict(self.options)), schema, dict(self.options))

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.pages(dict(self.options)), schema)


def listed(spark: SparkSession, path: str, since: str | None = None, source: type[Pages] = Pages, **options: str) -> DataFrame:
    """Records of all pages, or those not older than ``since``; pages behind them are not read."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(source.name()).options(**options).load(path)
    return rows if since is None else rows.where(rows["date"] >= since)


def from_sources(spark: SparkSession, paths: dict[str, str], since: str | None = None, source: type[Pages] = Pages) -> tuple[DataFrame, dict[str, str]]:
    """(records of several lists with their ``source``, and the error of each list whose first page can't be had).

    One list's failure leaves the others as they are. Equal records of two lists both stay.
    """
    out, errors = spark.createDataFrame([], SCHEMA + ", source string"), {}
    for name, path in paths.items():
        try:
            source.pages({"path": path}).fetch(1)
        except (OSError, ValueError) as e:
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        out = out.unionByName(listed(spark, path, since, source).withColumn("source", F.lit(name)))
    return out, errors


def follow(spark: SparkSession, path: str, target: str, checkpoint: str, source: type[Pages] = Pages):
    """Append the records that are new since the last run to ``target`` and end; returns the query."""
    spark.dataSource.register(source)
    rows = spark.readStream.format(source.name()).load(path)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
