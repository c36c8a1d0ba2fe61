"""Offenses of a SIEM as a streaming source of Spark, whose offset is the last start time that was read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id long, description string, severity int, status string, start_time long, offense_type string"
NAMES = tuple(c.split()[0] for c in SCHEMA.split(", "))
#: Offenses of a page, about.
PAGE = 1000
#: fetch(after, until, limit): the offenses, as dicts, that start after one time and up to another (None: any), by start time, so many at most.
Fetch = Callable[[int, int | None, int], list[dict]]


def whole_page(fetch: Fetch, after: int, until: int | None, limit: int) -> list[dict]:
    """A page of offenses that ends between two start times: those that start at the time of its last one come whole."""
    page = sorted(fetch(after, until, limit), key=lambda o: o["start_time"])
    if len(page) < limit:
        return page
    last = page[-1]["start_time"]
    own, more = [], limit
    while len(own := fetch(last - 1, last, more)) >= more:
        more *= 2
    return [o for o in page if o["start_time"] < last] + own


def offense_source(fetch: Fetch, name: str = "offenses") -> type[DataSource]:
    """A data source to register with spark.dataSource.register, and to read by spark.readStream.format(name).

    Options: since (a start time in milliseconds; 0), page (offenses of a batch, about; PAGE), and status and above: only offenses
    of that status, and above that severity. The offset is the last start time, which Spark keeps in the checkpoint, so after a
    restart each offense comes once, if offenses don't start in the past. A batch is a page.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.since, self.page = int(options.get("since", 0)), int(options.get("page", PAGE))
            self.status, self.above = options.get("status"), float(options.get("above", "-inf"))

        def rows(self, page: list[dict]) -> Iterator[tuple]:
            kept = [o for o in page if self.status in (None, o.get("status")) and (o.get("severity") or 0) > self.above]
            return iter([tuple(o.get(n) for n in NAMES) for o in kept])  # Spark keeps a page for its batch

        def initialOffset(self) -> dict:  # noqa: N802
            return {"after": self.since}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            page = whole_page(fetch, start["after"], None, self.page)
            return self.rows(page), {"after": page[-1]["start_time"] if page else start["after"]}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
            after = start["after"]
            while after < end["after"] and (page := whole_page(fetch, after, end["after"], self.page)):
                yield from self.rows(page)
                after = page[-1]["start_time"]

        def commit(self, end: dict) -> None:
            """The source forgets nothing, so there is nothing to do."""

    class Offenses(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> Reader:  # noqa: N802
            return Reader(self.options)

    return Offenses
