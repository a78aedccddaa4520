"""A paged search service as a Spark data source, one partition per year.

Options: url, start_year, end_year, rows (a page's size, 500), pause (seconds
between pages, 1.0), timeout (60). Filters on year are pushed down as the years
that are asked for; the other clauses are fixed in the request. A reader pages
until the number of hits or an empty page is reached; an HTTP error ends the
task, which Spark runs again.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..schemas import SEARCH_DOCUMENT

#: The clauses of the request, and the columns it asks for.
CLAUSES = ["doc_type:full", 'journal:"PLOS ONE"', 'article_type:"Research Article"', 'subject:"Psychology"']
FIELDS = "id,subject,publication_date"

_YEAR_FILTERS: dict[type, Callable] = {
    EqualTo: lambda y, v: y == v,
    GreaterThan: lambda y, v: y > v,
    GreaterThanOrEqual: lambda y, v: y >= v,
    LessThan: lambda y, v: y < v,
    LessThanOrEqual: lambda y, v: y <= v,
    In: lambda y, v: y in v,
}


class YearPartition(InputPartition):
    def __init__(self, year: int):
        super().__init__(year)
        self.year = year


def page_url(url: str, year: int, start: int, rows: int) -> str:
    clauses = [*CLAUSES, f"publication_date:[{year}-01-01T00:00:00Z TO {year}-12-31T23:59:59Z]"]
    query = [("q", "*:*"), *[("fq", c) for c in clauses], ("fl", FIELDS), ("wt", "json"), ("rows", rows), ("start", start)]
    return f"{url}?{urllib.parse.urlencode(query)}"


def pages(url: str, year: int, rows: int, pause: float, timeout: float) -> Iterator[dict]:
    """All hits of one year."""
    start = 0
    while True:
        with urllib.request.urlopen(page_url(url, year, start, rows), timeout=timeout) as answer:
            body = json.load(answer)["response"]
        found = body.get("docs", [])
        yield from found
        start += rows
        if not found or start >= body.get("numFound", 0):
            return
        time.sleep(pause)


def probe(url: str, clauses: list[str], timeout: float = 60) -> list[tuple[str, int]]:
    """(clause, hits) with the clauses added one after the other."""
    out = []
    for n in range(1, len(clauses) + 1):
        query = [("q", "*:*"), *[("fq", c) for c in clauses[:n]], ("wt", "json"), ("rows", 0)]
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=timeout) as answer:
            out.append((clauses[n - 1], json.load(answer)["response"]["numFound"]))
    return out


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.years = list(range(int(options["start_year"]), int(options["end_year"]) + 1))
        self.rows, self.pause, self.timeout = int(options.get("rows", 500)), float(options.get("pause", 1.0)), float(options.get("timeout", 60))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        for f in filters:
            test = _YEAR_FILTERS.get(type(f))
            if test is not None and f.attribute == ("year",):
                self.years = [y for y in self.years if test(y, f.value)]
            else:
                yield f

    def partitions(self):
        return [YearPartition(y) for y in self.years] or [YearPartition(-1)]

    def read(self, partition: YearPartition):
        if partition.year >= 0:
            for hit in pages(self.url, partition.year, self.rows, self.pause, self.timeout):
                yield (hit.get("id"), hit.get("subject") or [], hit.get("publication_date"), partition.year)


class SearchSource(DataSource):
    """After register(spark): spark.read.format("paged_search")"""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return SEARCH_DOCUMENT

    def reader(self, schema):
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
