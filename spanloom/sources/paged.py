"""Tables behind a service that answers in pages: read in parallel, again after failures, and from where a stream ended.

``spark.read.format("paged")`` and ``spark.readStream.format("paged")`` after ``register(spark)``.  Options: ``fetch``, the
name ``module:function`` of what answers for a page; ``schema`` comes from ``.schema(...)``; ``page`` rows of a page (100),
``pages`` of a partition (10), ``retries`` (5) and ``wait``, seconds before the first repetition, doubled each time (0.5).
``fetch(offset, length)`` returns (total, [(row's offset, row as a dict), ...]).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class PageRange(InputPartition):
    """Rows from start to end."""

    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.fetch, self.columns = options["fetch"], columns
        self.page, self.pages = int(options.get("page", 100)), int(options.get("pages", 10))
        self.retries, self.wait = int(options.get("retries", 5)), float(options.get("wait", 0.5))

    def _ask(self, offset: int, length: int):
        module, name = self.fetch.split(":")
        call = getattr(import_module(module), name)
        for attempt in range(self.retries + 1):
            try:
                return call(offset, length)
            except (OSError, TimeoutError):  # what a service that is busy or out of reach raises
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)

    def total(self) -> int:
        """How many rows there are now."""
        return int(self._ask(0, 1)[0])

    def ranges(self, start: int, end: int) -> list[PageRange]:
        """Rows start to end as partitions of whole pages."""
        step = self.page * self.pages
        return [PageRange(a, min(a + step, end)) for a in range(start, end, step)]

    def rows(self, own: PageRange) -> Iterator[tuple]:
        """The rows of a partition, each once and in order: a page's rows of other offsets are left out.

        A page without all its rows is asked for again like one that fails, and is an error at last.
        """
        for at in range(own.start, own.end, self.page):
            length = min(self.page, own.end - at)
            for attempt in range(self.retries + 1):
                found = {k: row for k, row in self._ask(at, length)[1] if at <= k < at + length}
                if len(found) == length:
                    break
                if attempt == self.retries:
                    raise OSError(f"rows {at} to {at + length} are incomplete")
                time.sleep(self.wait * 2**attempt)
            for k in sorted(found):
                yield tuple(found[k].get(c) for c in self.columns)


class _Batch(DataSourceReader):
    def __init__(self, pages: _Pages) -> None:
        self.pages = pages

    def partitions(self) -> list[PageRange]:
        return self.pages.ranges(0, self.pages.total())

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, pages: _Pages) -> None:
        self.pages = pages

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": self.pages.total()}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return self.pages.ranges(start["at"], end["at"])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class PagedSource(DataSource):
    """The data source ``paged``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def _pages(self, schema) -> _Pages:
        return _Pages(dict(self.options), [f.name for f in schema.fields])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._pages(schema))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self._pages(schema))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PagedSource)
