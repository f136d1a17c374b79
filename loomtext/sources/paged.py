"""Remote lists that come page by page, each page naming the next: a batch scan that can be resumed, and a stream.

A page can only be asked for after the one before it, so a scan is one task; everything after it is distributed.
``Fetch`` takes a token (None: the first page) and gives ``Page``; it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


@dataclass(frozen=True)
class Page:
    rows: list[tuple]  # the id is the first value of a row
    following: str | None = None
    items: int | None = None  # what the page held before unreadable rows were left out; None: as many as rows

    @property
    def empty(self) -> bool:
        return not (len(self.rows) if self.items is None else self.items)


Fetch = Callable[[str | None], Page]


@dataclass
class Scan:
    """Rows so far, the token from which a later scan goes on (None: the list is complete) and the pages read."""

    rows: list[tuple] = field(default_factory=list)
    token: str | None = None
    pages: int = 0


def walk(fetch: Fetch, token: str | None = None) -> Iterator[Page]:
    """Pages from ``token`` on, until none is named, one comes a second time or a page is empty.

    The last page has no ``following``, whatever the remote side said.
    """
    asked = {token}
    while True:
        page = fetch(token)
        if page.empty or page.following is None or page.following in asked:
            yield Page(page.rows, None, page.items)
            return
        token = page.following
        asked.add(token)
        yield page


def scan(fetch: Fetch, wanted: int | None = None, before: Scan | None = None) -> Scan:
    """Read until ``wanted`` different ids are known (None: to the end), going on from ``before``.

    The first row of an id stays. A scan that is complete or large enough is returned as it is.
    Raises ValueError if the first page has items and none can be read.
    """
    done = Scan(list(before.rows), before.token, before.pages) if before else Scan()
    if done.pages and (done.token is None or wanted is not None and len(done.rows) >= wanted):
        return done
    seen = {row[0] for row in done.rows}
    for page in walk(fetch, done.token):
        new: dict = {}
        for row in page.rows:
            if row[0] not in seen:
                new.setdefault(row[0], row)
        done.rows += new.values()
        seen |= new.keys()
        done.token, done.pages = page.following, done.pages + 1
        if done.pages == 1 and page.items and not page.rows:
            raise ValueError(f"none of the {page.items} items of the first page can be read")
        if wanted is not None and len(done.rows) >= wanted:
            break
    return done


def scanned(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of a scan with their place ``pos`` from 0."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"pos INT, {schema}")


def pages_for(number: int, size: int) -> int:
    """How many pages of ``size`` rows hold the first ``number`` rows; one at least."""
    return max(1, -(-number // size))


class _Pages(SimpleDataSourceStreamReader):
    """A page for each step; the offset is the token of the next page, so a restarted query goes on where it stopped.

    The stream ends at a page that is empty, names none or names itself; longer circles are told only by ``walk``.
    """

    def __init__(self, fetch: Fetch):
        self.fetch = fetch

    def initialOffset(self) -> dict:
        return {"token": None, "pages": 0, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        page = self.fetch(start["token"])
        last = page.empty or page.following is None or page.following == start["token"]
        return iter(page.rows), {"token": start["token"] if last else page.following, "pages": start["pages"] + 1, "done": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, at = [], start
        while at != end:
            more, at = self.read(at)
            rows += more
            if at["done"]:
                break
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


def source(fetch: Fetch, columns: str, label: str = "paged") -> type[DataSource]:
    """A stream source of a paged list, to be registered with ``spark.dataSource.register``.

    A page may repeat ids of earlier ones; ``dropDuplicates`` on the stream keeps the first.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Pages(fetch)

    return Paged
