"""Paged and batched REST sources.

The transport is a callable that answers ``(status, headers, body)``, so that readers run without a network and every
status reaches the retry rule.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RETRIED = {429, 500, 502, 503, 504}
LONGEST_WAIT = 30.0
#: Most ids in one look-up.
ARTIST_BATCH, ALBUM_BATCH = 50, 20
#: Most items that one task asks for.
MOST_ITEMS = 100_000

Answer = tuple[int, dict, object]


def wait_of(asked: object, otherwise: float, now: datetime | None = None) -> float:
    """Seconds to wait by a ``Retry-After`` value: a number of seconds or a date; never below zero, never beyond the bound.

    A value that is neither counts as none.
    """
    wait = otherwise
    if asked is not None:
        try:
            wait = float(str(asked))
        except ValueError:
            try:
                date = parsedate_to_datetime(str(asked))
                wait = ((date if date.tzinfo else date.replace(tzinfo=UTC)) - (now or datetime.now(UTC))).total_seconds()
            except ValueError:
                pass
    return min(max(wait, 0.0), LONGEST_WAIT) if wait == wait else otherwise


def with_retry(call: Callable[[], Answer], attempts: int = 5, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The body of the first good answer; waits double, and ``Retry-After`` is obeyed, up to a bound."""
    for k in range(attempts):
        status, headers, body = call()
        if status < 400:
            return body
        if status not in RETRIED or k + 1 == attempts:
            raise RuntimeError(f"the service answered {status}")
        asked = next((v for name, v in headers.items() if name.lower() == "retry-after"), None)
        sleep(wait_of(asked, first_wait * 2**k))
    raise RuntimeError("no attempt was allowed")


def all_pages(fetch: Callable[[int, int], Answer], size: int = 50, **retry) -> Iterator[dict]:
    """Items page by page until the body's total is reached or a page is empty; null items are dropped."""
    offset = 0
    while True:
        page = with_retry(lambda: fetch(offset, size), **retry)
        items = page.get("items") or []
        yield from (x for x in items if x is not None)
        offset += len(items)
        if not items or offset >= page.get("total", 0):
            return


def in_batches(ids: list, fetch: Callable[[list], Answer], size: int, **retry) -> Iterator[dict]:
    """Look-ups of many ids; items that the service doesn't know are dropped."""
    for a in range(0, len(ids), size):
        yield from (x for x in with_retry(lambda a=a: fetch(ids[a : a + size]), **retry) if x is not None)


def look_up(ids: DataFrame, key: str, transport: Callable[[list], Answer], schema: StructType, size: int = ARTIST_BATCH) -> DataFrame:
    """The items of all distinct ids of a column, asked for in batches by the tasks that hold them; null ids ask nothing."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list = []
        arrow = _arrow_schema(schema)

        def asked(part: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in in_batches(part, transport, size)], arrow)

        for batch in batches:
            wanted += batch.column(0).to_pylist()
            while len(wanted) >= size:
                yield asked(wanted[:size])
                wanted = wanted[size:]
        if wanted:
            yield asked(wanted)

    return ids.select(key).where(F.col(key).isNotNull()).distinct().mapInArrow(run, schema)


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def offline(offset: int, size: int, options: dict) -> Answer:
    """A service of ``total`` numbered items that needs no network."""
    total = int(options.get("total", 100))
    return 200, {}, {"total": total, "items": [{"id": k, "name": f"item {k}"} for k in range(offset, min(offset + size, total))]}


def _named(transport: str) -> Callable[..., Answer]:
    module, _, name = transport.partition(":")
    return getattr(importlib.import_module(module), name)


class PagedSource(DataSource):
    """``cadenza_pages``: the items of a paged service, as a batch or as a stream.

    Options: ``transport`` (module:function of offset, size and the options; ``offline`` where left out), ``size`` of a
    page, ``tasks``, ``first_wait`` of the retry rule, and those of the transport. The service's total is split into one
    range of items for each task, into more where a range would have over ``MOST_ITEMS``. Within its range a task asks again from where the last answer ended, so a service that
    gives shorter pages than asked for loses nothing; it stops at its first empty page. Fields are taken by name from the
    schema given to the reader; ``position`` is an item's place in the service's order.

    As a stream an offset is the next item's position: each batch has what the service has gained, and a restart goes on
    with the first item that no finished batch had.
    """

    @classmethod
    def name(cls) -> str:
        return "cadenza_pages"

    def schema(self) -> str:
        return "id long, name string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(schema.fieldNames(), dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PagedStream(schema.fieldNames(), dict(self.options))


class _Pages:
    """Ranges of a service's items."""

    def __init__(self, names: list[str], options: dict):
        self.names, self.options = names, options
        self.size, self.tasks = int(options.get("size", 50)), int(options.get("tasks", 4))

    def page(self, offset: int, size: int) -> dict:
        fetch = _named(self.options.get("transport", "cadenza.sources.rest:offline"))
        return with_retry(lambda: fetch(offset, size, self.options), first_wait=float(self.options.get("first_wait", 0.5)))

    def total(self) -> int:
        return int(self.page(0, 1).get("total", 0))

    def ranges(self, first: int, last: int) -> list[InputPartition]:
        each = max(min(-(-(last - first) // self.tasks), MOST_ITEMS), self.size, 1)
        return [InputPartition((a, min(a + each, last))) for a in range(first, last, each)]

    def items(self, partition: InputPartition) -> Iterator[tuple]:
        at, last = partition.value
        while at < last:
            items = (self.page(at, min(self.size, last - at)).get("items") or [])[: last - at]
            if not items:
                return
            for k, x in enumerate(items):
                if x is not None:
                    yield tuple(at + k if n == "position" else x.get(n) for n in self.names)
            at += len(items)


class _PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.ranges(0, self.total()) or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.items(partition)


class _PagedStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": self.total()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start["next"], end["next"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.items(partition)


def read_pages(spark: SparkSession, schema: str | None = None, **options: object) -> DataFrame:
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("cadenza_pages").options(**options)
    return (reader.schema(schema) if schema else reader).load()


def stream_pages(spark: SparkSession, schema: str, **options: object) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("cadenza_pages").options(**options).schema(schema).load()
