"""Exact order statistics and global row numbers without a task that holds a whole group or table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketches: their rank error is at most a group's size over ``ACCURACY``; brackets are ``MARGIN`` times as wide.
ACCURACY, MARGIN = 10_000, 10
#: Groups whose brackets are sent to all tasks; more are joined.
MOST_GROUPS = 20_000


def medians(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups`` and the exact median: the mean of the two middle values; nulls don't count, and a group of nulls has none.

    One pass makes a sketch of bounded size for each group, merged from the tasks' own; it gives two values between which
    the middle lies for certain. A second pass counts what lies below, and each distinct value between them: a few
    thousandths of a group, which alone are put in order. Both passes are summed before their shuffles. Group columns must
    not be null.
    """
    known = rows.select(*groups, F.col(value).cast("double").alias("__v"))
    off = MARGIN / ACCURACY
    sketches = known.groupBy(*groups).agg(F.percentile_approx("__v", [0.5 - off, 0.5 + off], ACCURACY).alias("__ends"), F.count("__v").alias("__total"))
    few = sketches.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS:
        brackets = F.broadcast(rows.sparkSession.createDataFrame(few, sketches.schema))
    else:
        brackets = sketches
    near = known.join(brackets, groups).where(F.col("__v") <= F.col("__ends")[1])
    # what lies below the bracket is one value, the first
    counted = near.groupBy(*groups, "__total", F.when(F.col("__v") >= F.col("__ends")[0], F.col("__v")).alias("__v")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*groups).orderBy(F.asc_nulls_first("__v")))
    places = counted.withColumn("__upto", upto)

    def at(place: Column) -> Column:
        found = F.min(F.when(F.col("__upto") >= place, F.struct("__upto", "__v")))["__v"]
        return F.coalesce(found, F.raise_error(F.lit("a sketch missed the middle of its group")).cast("double"))

    low, high = at(F.floor((F.col("__total") + 1) / 2)), at(F.floor(F.col("__total") / 2) + 1)
    found = places.groupBy(*groups).agg((low + (high - low) * 0.5).alias("median"))
    return brackets.select(*groups).join(found, groups, "left")


def numbered(df: DataFrame, order: list[Column], write: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """``df`` with ``row_number`` (from 1, in order), and with ``size`` also ``page``.

    One sort by ranges: each task knows its rows' places among its own; the sizes of the ranges before, a number for each
    task, are added. ``write`` puts the sorted rows where all tasks can read them, so that both reads see the same ranges.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write(sorted_.withColumns({"__range": F.spark_partition_id(), "__place": place}))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task of the sort
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(starts), "__range").withColumn("row_number", F.col("__before") + F.col("__place") + 1)
    if size:
        out = out.withColumn("page", F.floor((F.col("row_number") - 1) / size) + 1)
    return out.drop("__range", "__place", "__before")
