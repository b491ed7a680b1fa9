"""Pages, closed sort keys and scans by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ranks import numbered
from cadenza.sources.sinks import written

DEFAULT_SIZE, LARGEST_SIZE = 20, 200


def clamped(page: int, size: int) -> tuple[int, int]:
    return max(1, page), min(max(1, size), LARGEST_SIZE)


def sort_columns(sorts: dict[str, list[Column]], sort: str) -> list[Column]:
    if sort not in sorts:
        raise ValueError(f"sort must be one of {', '.join(sorted(sorts))}")
    return sorts[sort]


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = DEFAULT_SIZE, total: str | None = None) -> DataFrame:
    """One page in order: the best rows of each task meet, not the table. ``total`` adds the true number of rows."""
    page, size = clamped(page, size)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias(total)))) if total else rows


def pages(df: DataFrame, order: list[Column], size: int = LARGEST_SIZE) -> Iterator[DataFrame]:
    """All pages, one after the other, for callers that need pages; otherwise use ``df`` itself, or ``all_pages``."""
    _, size = clamped(1, size)
    count = df.count()
    for page in range(1, -(-count // size) + 1):
        yield page_of(df, order, page, size)


def all_pages(df: DataFrame, order: list[Column], size: int = LARGEST_SIZE) -> DataFrame:
    """Every row with its ``row_number`` and ``page``, by one sort for all pages; ``order`` must name unique keys."""
    _, size = clamped(1, size)
    return numbered(df, order, lambda rows: written(rows, "pages"), size)


def keyset_batch(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next rows by key; the size is kept within 100 and 50,000."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(min(max(size, 100), 50_000))
