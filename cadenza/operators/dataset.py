"""Training sets, regression metrics, gates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import seeded_bucket

SEED, FRACTION, BUCKETS = 20260730, 0.2, 1_000_000


def is_test(identifier: Column, seed: int = SEED, fraction: float = FRACTION) -> Column:
    if not 0.05 <= fraction <= 0.5:
        raise ValueError("the test share must lie between 0.05 and 0.5")
    return seeded_bucket(identifier, seed, BUCKETS) < int(fraction * BUCKETS)


def reason(include_imputed: bool = False) -> Column:
    """First reason for which a candidate is left out, null if none: popularity, has_features, is_complete, is_imputed."""
    found = F.when(F.col("popularity").isNull(), "missing_popularity").when(~F.col("has_features"), "missing_features").when(~F.col("is_complete"), "incomplete_features")
    return found if include_imputed else found.when(F.col("is_imputed"), "imputed_features")


def statistics(candidates: DataFrame, include_imputed: bool = False, seed: int = SEED, fraction: float = FRACTION) -> DataFrame:
    why = candidates.withColumn("reason", reason(include_imputed)).withColumn("test", is_test(F.col("id").cast("string"), seed, fraction))
    eligible = F.col("reason").isNull()
    of = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False)))
    return why.agg(
        F.count("*").alias("total"),
        of("missing_popularity").alias("missing_popularity"),
        of("missing_features").alias("missing_features"),
        of("incomplete_features").alias("incomplete_features"),
        F.count_if(eligible & ~F.col("is_imputed")).alias("eligible_measured"),
        F.count_if((eligible & F.col("is_imputed")) | F.coalesce(F.col("reason") == "imputed_features", F.lit(False))).alias("eligible_imputed"),
        of("imputed_features").alias("excluded_by_policy"),
        F.count_if(eligible & ~F.col("test")).alias("training_rows"),
        F.count_if(eligible & F.col("test")).alias("test_rows"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R² in one pass (R² is 0 without variance); no row for an empty input."""
    error = F.col(actual) - F.col(predicted)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.sum(error * error).alias("sse"), (F.var_pop(actual) * F.count(actual)).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst")).otherwise(0.0)
    return sums.where("n > 0").select("n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round(r2, 6).alias("r2"))


def mean_baseline(train: DataFrame, test: DataFrame, actual: str) -> DataFrame:
    mean = train.agg(F.avg(actual).alias("__mean"))
    return regression_metrics(test.crossJoin(F.broadcast(mean)), actual, "__mean")


def importance_rollup(df: DataFrame) -> DataFrame:
    """``df``: feature, slot, r2_drop, r2_sd, mae_rise, mae_sd: summed over slots, deviations in quadrature."""
    root = lambda c: F.round(F.sqrt(F.sum(F.col(c) * F.col(c))), 6).alias(c)
    return df.groupBy("feature").agg(F.round(F.sum("r2_drop"), 6).alias("r2_drop"), root("r2_sd"), F.round(F.sum("mae_rise"), 6).alias("mae_rise"), root("mae_sd"))


def passes_gate(mae: float, baseline: float, share: float = 0.95) -> bool:
    return mae <= share * baseline


def promoted(mae: float, baseline: float, current: float | None) -> bool:
    return passes_gate(mae, baseline) and (current is None or mae <= current)


def approved_blocks(base_mae: float, block_mae: dict[str, float], least_gain: float = 0.02) -> list[str]:
    return [b for b, mae in block_mae.items() if base_mae > 0 and (base_mae - mae) / base_mae >= least_gain]


def block_sets(blocks: list[str]) -> list[tuple[str, ...]]:
    """All combinations, the empty one first."""
    return [c for n in range(len(blocks) + 1) for c in combinations(blocks, n)]


def champion(maes: dict[tuple[str, ...], float], approved: list[str]) -> tuple[str, ...]:
    """The feature set with the lowest error among the base and the sets of approved blocks."""
    open_sets = [s for s in maes if set(s) <= set(approved)]
    return min(open_sets, key=lambda s: (maes[s], len(s), s))


#: Ranges of ad-hoc input.
RANGES = {
    "danceability": (0.0, 1.0), "energy": (0.0, 1.0), "valence": (0.0, 1.0), "acousticness": (0.0, 1.0), "instrumentalness": (0.0, 1.0), "liveness": (0.0, 1.0), "speechiness": (0.0, 1.0),
    "tempo": (0.0, 300.0), "loudness": (-60.0, 5.0), "duration_ms": (1_000, 7_200_000), "key": (0, 11), "mode": (0, 1), "time_signature": (0, 7),
}
#: Values of features that may be left out; all others must be given.
DEFAULTS = {"key": 0, "mode": 0, "time_signature": 4, "explicit": False, "genre": None}


def checked_input(track_id: str | None = None, features: dict[str, object] | None = None) -> tuple[str | None, dict[str, object] | None]:
    """Either a track or its features, not both; features must be known, complete and in their ranges."""
    if (track_id is None) == (features is None):
        raise ValueError("give a track or features, not both")
    if features is None:
        return track_id, None
    if unknown := sorted(set(features) - set(RANGES) - set(DEFAULTS)):
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    whole = DEFAULTS | features
    if missing := [n for n in RANGES if whole.get(n) is None]:
        raise ValueError(f"missing features: {', '.join(missing)}")
    for name, (low, top) in RANGES.items():
        if not low <= whole[name] <= top:
            raise ValueError(f"{name} must lie between {low} and {top}")
    return None, whole


def first_out_of_range(names: list[str]) -> Column:
    """The first of the named columns, in the order of ``RANGES``, that is null or out of its range; null if none is."""
    found = [F.when(F.col(n).isNull() | ~F.col(n).between(*RANGES[n]), n) for n in RANGES if n in names]
    return F.coalesce(*found)
