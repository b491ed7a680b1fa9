"""Record matching, imputation by medians, loading rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import split_credits
from cadenza.operators import ranks
from cadenza.sources.sinks import written

TOLERANCE_MS = 2000
#: Rows from which a key counts as frequent, and tasks that its rows are dealt to.
HOT_ROWS, DEALT = 10_000, 64
CONTINUOUS = ("danceability", "energy", "valence")
DISCRETE = ("key", "mode", "time_signature")


def match_chain(rows: DataFrame, tracks: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """``rows``: row_id, external_id, match_key, duration_ms; ``tracks``: id, match_key, duration_ms.

    The first rule that hits wins: same id; same key and a duration within the tolerance (nearest, then least id); same
    key (least id). The range rule joins on the key and a duration cell and its two neighbours, and every rule is
    reduced to one candidate for each row before the shuffle, so that a popular key makes no wide rows.

    Every side grows with the tables, and packed files look small to the planner: the joins are merges, so that none of
    them is broadcast through the driver.
    """
    by_id = rows.join(tracks.select(F.col("id").alias("external_id"), F.lit(1).alias("hit")).hint("merge"), "external_id", "left_semi").select("row_id", F.col("external_id").alias("by_id"))
    keyed = tracks.where("match_key <> '|'")
    cell = F.floor(F.col("duration_ms") / tolerance)
    # of tracks with one key and duration the least id alone can win
    cells = keyed.groupBy("match_key", "duration_ms").agg(F.min("id").alias("id")).select("id", "match_key", F.col("duration_ms").alias("their_ms"), cell.alias("cell"))
    asked = rows.select("row_id", "match_key", "duration_ms", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    near = asked.join(cells.hint("merge"), ["match_key", "cell"]).withColumn("gap", F.abs(F.col("duration_ms") - F.col("their_ms"))).where(F.col("gap") <= tolerance)
    near = near.groupBy("row_id").agg(F.min(F.struct("gap", "id")).alias("near"))
    least = keyed.groupBy("match_key").agg(F.min("id").alias("by_key"))
    joined = by_frequent_key(rows.join(by_id.hint("merge"), "row_id", "left").join(near.hint("merge"), "row_id", "left"), least, "match_key", "row_id", counted=rows)
    kind = F.when(F.col("by_id").isNotNull(), "id").when(F.col("near").isNotNull(), "key_duration").when(F.col("by_key").isNotNull(), "key").otherwise("none")
    return joined.select("row_id", F.coalesce("by_id", "near.id", "by_key").alias("track_id"), kind.alias("match_kind"))


def by_frequent_key(rows: DataFrame, facts: DataFrame, key: str, row: str, hot: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row for each key); rows of a key with over ``hot`` are dealt to ``DEALT`` tasks.

    ``counted``: the same keys, cheaper to read.
    """
    frequent = F.broadcast((rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(key, F.lit(True).alias("__hot")))
    dealt = F.when(F.col("__hot") | F.col(key).isNull(), F.pmod(F.xxhash64(row), F.lit(DEALT))).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), DEALT - 1).otherwise(0)))
    each = facts.join(frequent, key, "left").withColumn("__part", copies).drop("__hot")
    return rows.join(frequent, key, "left").withColumn("__part", dealt).drop("__hot").join(each.hint("merge"), [key, "__part"], "left").drop("__part")


def unique_keys(catalogue: DataFrame) -> DataFrame:
    """(match_key, id) of keys that one id only has."""
    return catalogue.where("match_key <> '|'").groupBy("match_key").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("id")).where("ids = 1").drop("ids")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    best = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(best, [*keys, order], "left_semi")


def medians(df: DataFrame, genre: str, measures: list[str]) -> DataFrame:
    """Exact medians for each genre, and over all rows (genre null), those without a genre included."""
    cleaned = df.select(F.nullif(F.lower(F.trim(genre)), F.lit("")).alias("genre"), *(F.col(m).cast("double").alias(m) for m in measures))
    group = F.array_compact(F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("genre")), F.when(F.col("genre").isNotNull(), F.struct(F.lit(False).alias("whole"), "genre"))))
    long = cleaned.select(F.explode(group).alias("g"), *measures).select("g.whole", "g.genre", *measures).unpivot(["whole", "genre"], measures, "measure", "value")
    found = ranks.medians(long, ["whole", "genre", "measure"], "value")
    turned = found.groupBy("whole", "genre").agg(*(F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in measures))
    return turned.select(F.when(~F.col("whole"), F.col("genre")).alias("genre"), *measures)


def impute(df: DataFrame, genre: str, continuous: list[str], discrete: list[str]) -> DataFrame:
    """Missing measures from the genre's median, else the overall one, else 0; discrete ones rounded half away from zero."""
    measures = [*continuous, *discrete]
    profile = written(medians(df, genre, measures), "profile")  # a row for each genre, read twice
    own = profile.where("genre IS NOT NULL").select(F.col("genre").alias("__genre"), *(F.col(m).alias(f"__own_{m}") for m in measures))
    every = profile.where("genre IS NULL").select(*(F.col(m).alias(f"__all_{m}") for m in measures))
    joined = df.withColumn("__genre", F.nullif(F.lower(F.trim(genre)), F.lit(""))).join(own, "__genre", "left").crossJoin(F.broadcast(every))

    def filled(m: str) -> Column:
        estimate = F.coalesce(f"__own_{m}", f"__all_{m}", F.lit(0.0))
        return F.coalesce(F.col(m).cast("double"), F.round(estimate) if m in discrete else estimate).alias(m)

    names = F.array_compact(F.array(*(F.when(F.col(m).isNull(), m) for m in measures)))
    rest = [c for c in df.columns if c not in measures]
    return joined.select(*rest, *map(filled, measures), (F.size(names) > 0).alias("is_imputed"), names.alias("imputed_names"))


def import_quality(df: DataFrame) -> DataFrame:
    """``df``: match_kind, duplicate, imputed."""
    matched = F.col("match_kind") != "none"
    counts = df.agg(
        F.count("*").alias("rows_read"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("match_kind") == "id").alias("by_id"),
        F.count_if(F.col("match_kind") == "key_duration").alias("by_key_duration"),
        F.count_if(F.col("match_kind") == "key").alias("by_key"),
        F.count_if(matched & F.col("duplicate")).alias("duplicates"),
        F.count_if(matched & F.col("imputed")).alias("imputed"),
    )
    rate = lambda a, b, name: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias(name)
    return counts.select("*", rate("matched", "rows_read", "match_rate"), rate(F.col("by_key_duration") + F.col("by_key"), F.col("matched"), "fallback_rate"), rate("imputed", "matched", "imputation_rate"))


def accumulate(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows``: row_id, playlist, track. Distinct tracks in first-seen order, playlists numbered by first sight.

    With ``most`` only the first so many playlists stay. Tracks that are null are left out, their playlists stay.
    """
    seen = rows.groupBy("playlist", "track").agg(F.min("row_id").alias("at"))
    lists = seen.groupBy("playlist").agg(
        F.min("at").alias("first_row"), F.transform(F.array_sort(F.collect_list(F.when(F.col("track").isNotNull(), F.struct("at", "track")))), lambda x: x["track"]).alias("track_ids")
    )
    return lists.orderBy("first_row").limit(most) if most else lists


def upsert(target: DataFrame, fresh: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """New keys are added, others overwritten; columns of ``kept`` are never overwritten by null."""
    a, b = target.alias("a"), fresh.withColumn("__new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")

    def chosen(c: str) -> Column:
        if c == key or c in kept:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        return F.when(F.col("__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return joined.select(*map(chosen, target.columns))


def enrich(references: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Matched references take the details found and count as enriched, others count one more attempt."""
    joined = references.join(found.withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.select(key, F.coalesce("detail", F.lit("")).alias("detail"), (hit | F.col("is_enriched")).alias("is_enriched"), F.when(hit, F.col("attempts")).otherwise(F.col("attempts") + 1).alias("attempts"))


def pending(references: DataFrame, batch: int, most_attempts: int = 5) -> DataFrame:
    return references.where(~F.col("is_enriched") & (F.col("attempts") < most_attempts)).orderBy("attempts", "id").limit(batch)


def credits_table(df: DataFrame, key: str, credits: str) -> DataFrame:
    return df.select(key, F.posexplode(split_credits(F.col(credits))).alias("position", "artist"))


def validity(df: DataFrame, measures: list[str]) -> Column:
    """Why a row is not loaded, null if it is."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = F.lit(False)
    for m in measures:
        missing = missing | F.col(m).isNull()
    return (
        F.when(blank("id"), "id")
        .when(blank("name"), "name")
        .when(F.col("popularity").isNull() | ~F.col("popularity").between(0, 100), "popularity")
        .when(F.col("duration_ms").isNull() | (F.col("duration_ms") < 0), "duration")
        .when(missing, "measures")
    )


def top_of_each(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
