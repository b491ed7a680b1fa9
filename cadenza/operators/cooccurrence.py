"""Which items share baskets, how often, and with what Jaccard weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Items of a basket that are paired in one task; larger baskets are dealt to pairs of parts.
PART = 500
#: Large baskets whose sizes are sent to all tasks; more are joined.
MOST_LARGE = 10_000


def frequent(memberships: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct memberships of items with ``least`` baskets or more (fewer can't make a pair), and those items' totals."""
    distinct = memberships.select("basket", "item").distinct()
    totals = distinct.groupBy("item").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    return distinct.join(totals.select("item"), "item", "left_semi"), totals


def pairs(memberships: DataFrame, least: int = 2) -> DataFrame:
    """``memberships``: basket, item (repeats count once). Pairs low < high in at least ``least`` baskets.

    A basket meets once, as a sorted array of its frequent items, and makes its pairs in place: n * (n - 1) / 2, as the
    definition asks. One with more than ``PART`` items is cut into parts by a hash of the item, and each two parts meet
    under a key of their own, so that it spreads over many tasks and no array is longer than two parts.
    """
    return _paired(memberships, frequent(memberships, least)[0], least)


def _paired(memberships: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    large = memberships.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("basket", F.ceil(F.col("n") / PART).alias("parts"))
    few = large.limit(MOST_LARGE + 1).collect()
    if few:
        sizes = F.broadcast(memberships.sparkSession.createDataFrame(few, large.schema)) if len(few) <= MOST_LARGE else large
        cut = kept.join(sizes, "basket", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("item"), F.col("parts")), F.lit(0).cast("long")))
        met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))))
        cells = met.groupBy("basket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.array_sort(F.collect_list(F.struct("item", "own"))).alias("items"))
        lows = cells.select("x", "y", F.posexplode("items").alias("k", "a"), "items")
        both = lows.select("x", "y", "a", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("b")).where("x = y OR a.own <> b.own")
        both = both.select(F.col("a.item").alias("low"), F.col("b.item").alias("high"))
    else:
        lows = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.posexplode("items").alias("k", "low"), "items")
        both = lows.select("low", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("high"))
    return both.groupBy("low", "high").agg(F.count("*").alias("co_count")).where(F.col("co_count") >= least)


def seed_edges(memberships: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """(seed, item, co_count, jaccard) of ``seeds`` (seed) alone: what ``of_seeds`` takes from the whole matrix, without making it."""
    distinct = memberships.select("basket", "item").distinct()
    asked = distinct.join(seeds.select(F.col("seed").alias("item")).distinct(), "item", "left_semi").withColumnRenamed("item", "seed")
    counted = asked.join(distinct, "basket").where("seed <> item").groupBy("seed", "item").agg(F.count("*").alias("co_count")).where(F.col("co_count") >= least)
    totals = distinct.groupBy("item").agg(F.count("*").alias("total"))
    sided = counted.join(totals.withColumnsRenamed({"item": "seed", "total": "seed_total"}), "seed").join(totals, "item")
    weight = F.col("co_count") / (F.col("seed_total") + F.col("total") - F.col("co_count"))
    return sided.select("seed", "item", "co_count", F.round(weight, 9).alias("jaccard"))


def matrix(memberships: DataFrame, least: int = 2) -> DataFrame:
    """Pairs with the baskets of each side and the Jaccard weight."""
    kept, totals = frequent(memberships, least)
    sided = _paired(memberships, kept, least).join(totals.select(F.col("item").alias("low"), F.col("total").alias("low_total")), "low")
    sided = sided.join(totals.select(F.col("item").alias("high"), F.col("total").alias("high_total")), "high")
    weight = F.col("co_count") / (F.col("low_total") + F.col("high_total") - F.col("co_count"))
    return sided.select("low", "high", "co_count", "low_total", "high_total", F.round(weight, 9).alias("jaccard"))


def of_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, item, co_count, jaccard) from both sides of the edges; ``seeds``: seed."""
    up = edges.join(seeds, edges.low == seeds.seed).select("seed", F.col("high").alias("item"), "co_count", "jaccard")
    down = edges.join(seeds, edges.high == seeds.seed).select("seed", F.col("low").alias("item"), "co_count", "jaccard")
    return up.unionByName(down)


def coverage(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("low").alias("item")).unionByName(edges.select(F.col("high").alias("item")))
    return ends.agg(F.countDistinct("item").alias("covered"))
