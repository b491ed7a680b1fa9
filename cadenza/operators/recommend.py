"""Blending of content and co-occurrence, collapse of near-duplicates, and the whole recommendation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.similarity import contributions, nearest, overfetch
from cadenza.sources.sinks import written

WEIGHT, SAME_COSINE, MOST = 0.35, 0.999, 100
COLLAPSED = "seed_id long, id long, rank long, score double, collapsed long, position long, round long"


def blend(content: DataFrame, collaborative: DataFrame, weight: float = WEIGHT, plain: DataFrame | None = None, keys: tuple[str, ...] = ("seed_id",)) -> DataFrame:
    """``content``: seed_id, id, score; ``collaborative``: seed_id, id, co_count, jaccard. Ranked for each seed.

    Content is rescaled to 0..1 over a seed's candidates (1 where they don't differ); a missing side counts 0. With
    ``plain`` (seed_id of those that have a collaborative side) the others keep their content's score and order. ``keys``:
    what a list belongs to, if a seed has several.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie in [0, 1]")
    bounds = Window.partitionBy(*keys)
    own = content.where("seed_id <> id").withColumn("low", F.min("score").over(bounds)).withColumn("top", F.max("score").over(bounds))
    own = own.select(*keys, "id", F.col("score").alias("own"), F.when(F.col("top") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("top") - F.col("low"))).otherwise(1.0).alias("content"))
    both = own.join(collaborative.where("seed_id <> id"), [*keys, "id"], "full")
    content_part, jaccard = F.coalesce("content", F.lit(0.0)), F.coalesce("jaccard", F.lit(0.0))
    signal = F.when(F.col("content").isNotNull() & F.col("jaccard").isNotNull(), "blended").when(F.col("jaccard").isNotNull(), "collaborative")
    mixed = F.round((1 - weight) * content_part + weight * jaccard, 9)
    if plain is not None:
        both = both.join(plain.select("seed_id", F.lit(True).alias("blends")), "seed_id", "left")
        mixed = F.when(F.col("blends"), mixed).otherwise(F.col("own"))
    final = both.select(*keys, "id", mixed.alias("score"), F.round(content_part, 9).alias("content"), jaccard.alias("jaccard"), F.coalesce("co_count", F.lit(0).cast("long")).alias("co_count"), signal.alias("signal"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("jaccard"), F.asc("id"))
    return final.withColumn("rank", F.row_number().over(order).cast("long"))


def collapse_by_key(ranked: DataFrame, limit: int) -> DataFrame:
    """Groups by key alone: the representative stands at the group's first rank; ``limit`` groups of each seed stay."""
    best = F.struct((-F.coalesce("popularity", F.lit(-1))).alias("p"), F.col("is_imputed").alias("i"), F.col("id").alias("id"))
    grouped = ranked.groupBy("seed_id", F.coalesce("key", F.concat(F.lit("#"), F.col("id").cast("string"))).alias("key")).agg(F.min("rank").alias("first_rank"), F.min(best).alias("best"), F.count("*").alias("n"))
    order = Window.partitionBy("seed_id").orderBy("first_rank")
    placed = grouped.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= limit)
    return placed.select("seed_id", F.col("best.id").alias("id"), "first_rank", (F.col("n") - 1).alias("collapsed"), "position")


def grouped(same: np.ndarray, keys: list[str | None], goodness: list[tuple], limit: int) -> tuple[list[int], list[int]]:
    """Representatives and numbers of others of the groups of rows in rank order, up to the opening of the last group.

    A row joins the group of its key, else the first group whose present representative it is the same as.
    """
    heads: list[int] = []
    others: list[int] = []
    home: dict[str, int] = {}
    for row, key in enumerate(keys):
        group = home.get(key) if key else None
        if group is None and heads:
            close = np.flatnonzero(same[row, heads])
            group = int(close[0]) if len(close) else None
        if group is None:
            group = len(heads)
            heads.append(row)
            others.append(0)
        else:
            heads[group] = max(heads[group], row, key=goodness.__getitem__)
            others[group] += 1
        if key:
            home.setdefault(key, group)
        if len(heads) == limit:
            break
    return heads, others


def collapse(ranked: DataFrame, limit: int, same: float = SAME_COSINE) -> DataFrame:
    """``ranked``: seed_id, id, rank, score, key, popularity, is_imputed, unit; at most ``overfetch``'s window for a seed.

    One pass in rank order, because a group's representative, with which the later ones are compared, changes on the way;
    the scan ends when the last group opens. Windows grow until ``limit`` groups are found. With a column ``round`` each
    round has rows of its own, and the first that gives enough is taken; without, a round takes the first rows.
    """
    windows = overfetch(limit)
    by_round = "round" in ranked.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        for n, window in enumerate(windows, 1):
            part = (rows[rows["round"] == n] if by_round else rows[:window]).reset_index(drop=True)
            heads, others = grouped(*prepared(part), limit)
            if len(heads) >= limit or (bool(part["exhausted"].all()) if by_round else window >= len(rows)):
                break
        kept = part.iloc[heads][["seed_id", "id", "rank", "score"]].copy()
        kept["collapsed"], kept["position"], kept["round"] = others, range(1, len(heads) + 1), n
        return kept

    def prepared(rows: pd.DataFrame) -> tuple[np.ndarray, list, list[tuple]]:
        alike = np.zeros((len(rows), len(rows)), bool)
        known = np.flatnonzero(rows["unit"].notna().to_numpy())
        if len(known):
            units = np.stack([np.asarray(u, float) for u in rows["unit"].iloc[known]])
            lengths = np.linalg.norm(units, axis=1)
            product = np.outer(lengths, lengths)
            alike[np.ix_(known, known)] = (product > 0) & (units @ units.T >= same * product)
        popularity = rows["popularity"].fillna(-1).tolist()
        return alike, rows["key"].tolist(), [(p, not i, -x) for p, i, x in zip(popularity, rows["is_imputed"], rows["id"], strict=True)]

    return ranked.groupBy("seed_id").applyInPandas(run, COLLAPSED)


WARNINGS = {"seed_imputed": "the seed's features are estimated", "genre_fallback": "the seed has no usable genre: ranked by cosine alone", "no_collaborative": "no shared playlists: content alone", "imputed_items": "some recommendations have estimated features"}


def recommend(seeds: DataFrame, index: DataFrame, limit: int = 10, mode: str = "boost", edges: DataFrame | None = None, weight: float = WEIGHT, reasons: int = 3) -> DataFrame:
    """Fetch, blend where ``edges`` (seed_id, id, co_count, jaccard) are given, collapse, keep the best ``limit``, explain.

    Each round of the search takes the first items of both lists, as many as its window has. Of each item: position,
    score (that it is ranked by), cosine, genre_boost, signal (null for content alone), co_count, jaccard, is_imputed,
    shared_genre, collapsed, the ``reasons`` dimensions that add most to the cosine, and the seed's warnings.
    """
    limit, reasons, windows = min(max(limit, 1), MOST), min(max(reasons, 1), 9), overfetch(min(max(limit, 1), MOST))
    # the search is read several times below and made once; vectors are joined to what is kept of it alone
    content = written(nearest(seeds, index, windows[-1], mode).select("seed_id", "id", "rank", "score", "cosine", F.round(F.col("score") - F.col("cosine"), 9).alias("genre_boost")), "near")
    asked = seeds.select(F.col("id").alias("seed_id"), F.nullif(F.trim("genre"), F.lit("")).alias("seed_genre"), F.col("is_imputed").alias("seed_imputed"), F.col("unit").alias("seed_unit"), F.col("length").alias("seed_length"))
    facts = index.select("id", "key", "popularity", "is_imputed", "unit", "length", "genre")
    if edges is None:
        listed = content.select("seed_id", "id", "rank", "score", F.lit(0).cast("long").alias("co_count"), F.lit(0.0).alias("jaccard"), F.lit(None).cast("string").alias("signal"))
        rounds, shared = listed, None
    else:
        order = Window.partitionBy("seed_id").orderBy(F.desc("jaccard"), F.desc("co_count"), F.asc("id"))
        best = written(edges.where("seed_id <> id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= windows[-1]), "edges")
        shared = best.select("seed_id").distinct().withColumn("collaborative", F.lit(True))
        found = content.groupBy("seed_id").agg(F.count("*").alias("fetched")).join(best.groupBy("seed_id").agg(F.count("*").alias("met")), "seed_id", "left")
        least = found.select("seed_id", F.greatest("fetched", F.coalesce("met", F.lit(0))).alias("available"))

        def turns(place: str) -> Column:
            """The rounds whose window a place lies in."""
            return F.explode(F.array_compact(F.array(*(F.when(F.col(place) <= w, F.lit(n)) for n, w in enumerate(windows, 1))))).alias("round")

        own, theirs = content.select("seed_id", "id", "score", turns("rank")), best.select("seed_id", "id", "co_count", "jaccard", turns("place"))
        mixed = blend(own, theirs, weight, plain=shared, keys=("round", "seed_id")).join(least, "seed_id", "left")
        width = F.element_at(F.array(*map(F.lit, windows)), F.col("round"))
        rounds = mixed.withColumn("exhausted", F.coalesce(F.col("available") <= width, F.lit(True))).drop("available", "content")
    extra = ["round", "exhausted"] if edges is not None else []
    given = rounds.join(facts, "id", "left").select("seed_id", "id", "rank", "score", "key", "popularity", F.coalesce("is_imputed", F.lit(False)).alias("is_imputed"), "unit", *extra)
    kept = collapse(given, limit)
    joined = kept.join(rounds.drop("rank", "score", "exhausted"), ["seed_id", "id", "round"] if extra else ["seed_id", "id"], "left")
    joined = joined.join(content.select("seed_id", "id", "cosine", "genre_boost"), ["seed_id", "id"], "left").join(facts.select("id", "genre", "is_imputed", "unit", "length"), "id", "left").join(asked, "seed_id")
    joined = joined.withColumn("why", F.when(F.col("cosine").isNotNull(), contributions(reasons)))
    joined = joined.join(shared, "seed_id", "left") if shared is not None else joined.withColumn("collaborative", F.lit(True))
    estimated = F.coalesce("is_imputed", F.lit(False))
    any_estimated = F.max(estimated).over(Window.partitionBy("seed_id"))  # at most ``limit`` rows
    usable = F.col("seed_genre").isNotNull() & ~F.col("seed_imputed")
    told = {"seed_imputed": F.col("seed_imputed"), "genre_fallback": ~usable & F.lit(mode != "off"), "no_collaborative": F.col("collaborative").isNull(), "imputed_items": any_estimated}
    return joined.select(
        "seed_id", "position", "id", "score", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("genre_boost", F.lit(0.0)).alias("genre_boost"), "signal", "co_count", "jaccard", estimated.alias("is_imputed"),
        F.when(F.col("cosine").isNotNull() & (F.col("genre") == F.col("seed_genre")), F.col("genre")).alias("shared_genre"), "collapsed", "rank", "round", F.coalesce("why", F.array().cast("array<struct<dimension:int,share:double>>")).alias("reasons"),
        F.array_compact(F.array(*(F.when(holds, name) for name, holds in told.items()))).alias("warnings"),
    )
