"""Quality of recommendations: genre coherence, closeness of duplicates, list sizes, and their gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_census(items: DataFrame) -> DataFrame:
    """``items``: key, eligible, is_imputed. Groups of two and more eligible items with one key."""
    groups = items.where("eligible").groupBy("key").agg(F.count("*").alias("n"), F.count_if("is_imputed").alias("i"))
    many = F.col("n") > 1
    return groups.agg(
        F.sum("n").alias("eligible"),
        F.sum("i").alias("imputed"),
        F.count_if(many).alias("groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0).cast("long")).alias("members"),
        F.coalesce(F.sum(F.when(many, (F.col("n") * (F.col("n") - 1) / 2).cast("long"))), F.lit(0).cast("long")).alias("pairs"),
        F.coalesce(F.max(F.when(many, F.col("n"))), F.lit(0).cast("long")).alias("largest"),
    )


def coherence(seeds: DataFrame, lists: DataFrame) -> DataFrame:
    """``seeds``: seed_id, seed_genre (null: unusable); ``lists``: seed_id, genre, is_imputed of each neighbour."""
    per_seed = seeds.join(lists.withColumn("__n", F.lit(1)), "seed_id", "left").groupBy("seed_id").agg(
        F.first("seed_genre").alias("seed_genre"), F.count("__n").alias("n"), F.count_if(F.coalesce(F.col("genre") == F.col("seed_genre"), F.lit(False))).alias("same"), F.count_if(F.coalesce("is_imputed", F.lit(False))).alias("imputed")
    )
    used = F.col("seed_genre").isNotNull() & (F.col("n") > 0)
    share = F.when(used, F.col("same") / F.col("n"))
    return per_seed.agg(
        F.count_if(used).alias("seeds_evaluated"),
        F.count_if(F.col("seed_genre").isNull()).alias("without_genre"),
        F.count_if(F.col("seed_genre").isNotNull() & (F.col("n") == 0)).alias("without_list"),
        F.round(F.coalesce(F.avg(share), F.lit(0.0)), 12).alias("mean"),
        F.round(F.coalesce(F.stddev_pop(share), F.lit(0.0)), 12).alias("deviation"),
        F.round(F.coalesce(F.try_divide(F.stddev_pop(share), F.sqrt(F.count(share))), F.lit(0.0)), 12).alias("standard_error"),
        F.round(F.coalesce(F.try_divide(F.count_if(used & (F.col("same") == F.col("n"))), F.count(share)), F.lit(0.0)), 12).alias("saturation"),
    )


def duplicates(seeds: DataFrame, lists: DataFrame, top_k: int) -> DataFrame:
    """``seeds``: seed_id, seed_key, siblings (other members of the group); ``lists``: seed_id, key, rank, cosine."""
    hit = F.coalesce(F.col("key") == F.col("seed_key"), F.lit(False))
    per_seed = seeds.join(lists, "seed_id", "left").groupBy("seed_id").agg(
        F.first("siblings").alias("siblings"),
        F.count("rank").alias("n"),
        F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(hit, F.col("cosine"))).alias("cosines"),
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 12)
    return per_seed.agg(
        F.count("*").alias("seeds_evaluated"),
        zero(F.avg(F.col("hits") / F.least("siblings", F.lit(top_k)))).alias("recall"),
        zero(F.avg((F.col("hits") > 0).cast("double"))).alias("hit_rate"),
        zero(F.avg("first_rank")).alias("mean_first_rank"),
        zero(F.try_divide(F.sum("cosines"), F.sum("hits"))).alias("sibling_cosine"),
        F.count_if((F.col("n") > 0) & (F.col("hits") == F.col("n"))).alias("fully_duplicated"),
        F.count_if(F.col("hits") >= 2).alias("redundant"),
        F.count_if(F.col("n") < top_k).alias("incomplete"),
    )


def list_sizes(collapsed: DataFrame) -> DataFrame:
    """``collapse``'s rows: how many seeds ended in each round with each number of items."""
    per_seed = collapsed.groupBy("seed_id").agg(F.max("round").alias("round"), F.count("*").alias("items"))
    return per_seed.groupBy("round", "items").agg(F.count("*").alias("seeds"))


#: The sample's seed text, its seeds and groups, and the members of a group that count in it.
SAMPLING, SEEDS, GROUPS, GROUP_MEMBERS = "e4.4-proxies-v1", 300, 300, 8


def sampled_seeds(items: DataFrame, sampling: str = SAMPLING, size: int = SEEDS) -> DataFrame:
    """(seed_id) of the items that come first by a seeded hash of their ids."""
    text = F.col("id").cast("string")
    return items.select(F.col("id").alias("seed_id")).orderBy(F.md5(F.concat(F.lit(sampling), text)), "id").limit(size)


def group_members(items: DataFrame, least: int = 2, sampling: str = SAMPLING, groups: int | None = None, most: int | None = None) -> DataFrame:
    """(key, id, size, place) of groups of ``least`` items or more with one key; items without a key are in no group.

    ``groups``: as many groups, the first by a seeded hash of their keys; ``most``: as many members of each, the first by id.
    """
    sizes = items.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    if groups is not None:
        sizes = sizes.orderBy(F.md5(F.concat(F.lit(sampling), "key")), "key").limit(groups)
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    members = items.select("key", "id").join(sizes, "key").withColumn("place", place.cast("long"))
    return members.where(F.col("place") <= most) if most is not None else members


def large_groups(items: DataFrame, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(seed_id, seed_key, siblings) of the leaders and of all members of groups so large that a seed's whole list could be
    its siblings; a leader is the first of its group by id."""
    members = group_members(items, top_n + 1).select(F.col("id").alias("seed_id"), F.col("key").alias("seed_key"), (F.col("size") - 1).alias("siblings"), "place")
    return members.where("place = 1").drop("place"), members.drop("place")


#: The gate's thresholds.
GATE = {"coherence": 0.40, "lift": 2.0, "saturation_most": 0.50, "recall": 0.45, "hit_rate": 0.50, "sibling_cosine": 0.98, "self_hits_most": 0, "short_most": 0.05, "redundant_most": 0, "single_most": 0}
#: The populations on which thresholds were set.
LEADERS, MEMBERS = "leaders of large groups", "members of large groups"


@dataclass(frozen=True)
class Measurement:
    """What was measured (one row of the functions above), over which seeds, and how the lists were made."""

    values: dict[str, float]
    population: str | None
    mode: str = "boost"
    strategy: str = "content"
    dedupe: bool = False
    top_n: int = 10

    @property
    def setting(self) -> tuple[str, str, bool, int]:
        return self.mode, self.strategy, self.dedupe, self.top_n


def sizes(collapsed: DataFrame, seeds: DataFrame, top_n: int) -> DataFrame:
    """One row: seeds, the share of them with fewer than ``top_n`` items, and how many have one item only."""
    counted = seeds.select("seed_id").join(collapsed.groupBy("seed_id").agg(F.count("*").alias("items")), "seed_id", "left").select(F.coalesce("items", F.lit(0).cast("long")).alias("items"))
    short = F.coalesce(F.avg((F.col("items") < top_n).cast("double")), F.lit(0.0))
    return counted.agg(F.count("*").alias("seeds_evaluated"), F.round(short, 12).alias("short"), F.count_if(F.col("items") == 1).alias("single"))


def self_hits(lists: DataFrame) -> DataFrame:
    """One row: how many lists hold their own seed."""
    return lists.agg(F.count_if(F.col("seed_id") == F.col("id")).alias("self_hits"))


def gate(measured: dict[str, float]) -> list[str]:
    """Names of the thresholds that are missed; a missing measure is refused."""
    if absent := sorted(set(GATE) - set(measured)):
        raise ValueError(f"not measured: {', '.join(absent)}")
    return [k for k, limit in GATE.items() if (measured[k] > limit if k.endswith("_most") else measured[k] < limit)]


def judged(plain: Measurement, boosted: Measurement, engine: Measurement, deduped: Measurement, lengths: Measurement) -> list[str]:
    """The gate over measurements; those that don't fit together, or whose seeds say nothing about a threshold, are refused.

    ``plain``, ``boosted``: coherence and self hits without and with the genre's boost; ``engine``: duplicates before they
    are collapsed; ``deduped``: duplicates after; ``lengths``: list sizes.
    """
    rules = {
        "the gate holds for recommendations by content alone": {plain.strategy, boosted.strategy} == {"content"},
        "both coherences must be measured with the same collapse": plain.dedupe == boosted.dedupe,
        "coherences need a named population": bool(plain.population and boosted.population),
        "both coherences must be measured on the same seeds": plain.population == boosted.population,
        "duplicates of the engine are measured before the collapse": not engine.dedupe,
        "repeats are measured after the collapse": deduped.dedupe,
        f"repeats are measured on the {LEADERS}, on one seed at least": deduped.population == LEADERS and deduped.values["seeds_evaluated"] > 0,
        "list sizes must be measured as the boosted lists are made": lengths.setting == boosted.setting,
        f"list sizes are measured on the {MEMBERS}": lengths.population == MEMBERS,
    }
    if broken := [rule for rule, holds in rules.items() if not holds]:
        raise ValueError("; ".join(broken))
    base = plain.values["mean"]
    return gate(
        {
            "coherence": boosted.values["mean"],
            "lift": boosted.values["mean"] / base if base > 0 else float("inf"),
            "saturation_most": boosted.values["saturation"],
            "recall": engine.values["recall"],
            "hit_rate": engine.values["hit_rate"],
            "sibling_cosine": engine.values["sibling_cosine"],
            "self_hits_most": plain.values["self_hits"] + boosted.values["self_hits"],
            "short_most": lengths.values["short"],
            "redundant_most": deduped.values["redundant"],
            "single_most": lengths.values["single"],
        }
    )
