"""Connected components by rounds of joins, without links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, materialize


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for each end of ``links`` (a, b), written: root is the least id that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014): each node's larger neighbours, then its smaller ones, are
    linked to the least one, until nothing changes. A node's neighbours are only aggregated to a minimum, which is
    combined before the shuffle, written, and joined back: no group is gathered, and a join can be split at a node with
    very many neighbours.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        forget(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "small")
        forget(large, least, edges)
        before, mark, edges = mark, _mark(small), small
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    out = materialize(stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), "roots")
    forget(edges)
    return out
