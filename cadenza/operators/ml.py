"""Popularity models on Spark ML: feature sets, boosted trees, linear baseline, cross-validation, permutation importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, OneHotEncoderModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import clamp
from cadenza.operators.dataset import approved_blocks, block_sets, champion, regression_metrics


#: The columns of every model, and what each block adds: numbers, categories.
BASE = ["danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "liveness", "speechiness", "loudness", "duration_ms", "explicit"]
BLOCKS: dict[str, tuple[list[str], list[str]]] = {"A": (["mode"], ["key", "time_signature"]), "B": ([], ["genre"])}
UNKNOWN = "<unknown>"


def feature_set(blocks: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of the base with some blocks."""
    return BASE + [c for b in blocks for c in BLOCKS[b][0]], [c for b in blocks for c in BLOCKS[b][1]]


def prepared(df: DataFrame, categories: list[str]) -> DataFrame:
    """Categories as text, missing ones named."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(UNKNOWN)) for c in categories})


def pipeline(numeric: list[str], categories: list[str], label: str, linear: bool = False, trees: int = 20) -> Pipeline:
    """Categories one-hot with a slot for unknown values, all slots scaled to 0..1, then the model."""
    indexed, coded = [f"__i_{c}" for c in categories], [f"__o_{c}" for c in categories]
    stages: list = []
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep", dropLast=False)]
    stages += [VectorAssembler(inputCols=[*numeric, *coded], outputCol="__slots", handleInvalid="keep"), MinMaxScaler(inputCol="__slots", outputCol="features")]
    stages.append(LinearRegression(labelCol=label) if linear else GBTRegressor(labelCol=label, maxIter=trees, maxDepth=5, seed=1))
    return Pipeline(stages=stages)


def elected(train: DataFrame, test: DataFrame, label: str, trees: int = 20) -> list[dict]:
    """The base and every combination of blocks, fitted and measured on the test rows; which blocks pay, which set wins.

    A block pays if alone it lowers the base's error by two per cent or more; sets with one that doesn't cannot win.
    The sets are fitted side by side: trees come one after another, and the jobs of a single model leave tasks free.
    """

    def measured(blocks: tuple[str, ...]) -> float:
        numeric, categories = feature_set(blocks)
        model = pipeline(numeric, categories, label, trees=trees).fit(prepared(train, categories))
        return regression_metrics(model.transform(prepared(test, categories)), label, "prediction").first()["mae"]

    sets = block_sets(list(BLOCKS))
    with ThreadPoolExecutor(len(sets)) as pool:
        maes = dict(zip(sets, pool.map(inheritable_thread_target(train.sparkSession)(measured), sets), strict=True))
    approved = approved_blocks(maes[()], {b: maes[b,] for b in BLOCKS})
    best = champion(maes, approved)
    return [{"features": "+".join(("base", *s)), "mae": mae, "approved": set(s) <= set(approved), "champion": s == best} for s, mae in maes.items()]


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``prediction`` held to 0..100, ``raw_score``, ``clamped``, and ``warnings``: imputed input, clamped output."""
    value, outside = clamp(F.col("prediction"))
    imputed = F.coalesce(F.col("is_imputed"), F.lit(False)) if "is_imputed" in df.columns else F.lit(False)
    out = model.transform(df).withColumn("clamped", outside).withColumn("raw_score", F.col("prediction")).withColumn("prediction", value)
    return out.withColumn("warnings", F.array_compact(F.array(F.when(imputed, "imputed_features"), F.when(F.col("clamped"), "clamped_output"))))


def cross_validated(df: DataFrame, build, label: str, identifier: str, folds: int = 5) -> tuple[float, float]:
    """Mean and population deviation of R² over folds dealt by a hash of the identifier."""
    dealt = df.withColumn("__fold", F.pmod(F.xxhash64(F.col(identifier).cast("string")), F.lit(folds)))
    found = []
    for k in range(folds):
        model = build().fit(dealt.where(F.col("__fold") != k))
        found.append(RegressionEvaluator(labelCol=label, metricName="r2").evaluate(model.transform(dealt.where(F.col("__fold") == k))))
    mean = sum(found) / folds
    return mean, (sum((r - mean) ** 2 for r in found) / folds) ** 0.5


def slots_of(model: PipelineModel, df: DataFrame) -> list[tuple[str, str]]:
    """(feature, slot) of each place of the assembled vector, from its metadata: a category has a slot for each value."""
    attributes = model.transform(df.limit(0)).schema["__slots"].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    coded = {f"__o_{c}_": c for s in model.stages if isinstance(s, OneHotEncoderModel) for c in (x.removeprefix("__o_") for x in s.getOutputCols())}

    def feature(name: str) -> tuple[str, str]:
        found = max((p for p in coded if name.startswith(p)), key=len, default=None)
        return (coded[found], f"{coded[found]}={name.removeprefix(found)}") if found else (name, name)

    return [feature(name) for _, name in named]


def partners(rows: DataFrame, identifier: str, permutations: int, buckets: int) -> DataFrame:
    """(identifier, __p, __x): the vector of another row, by a permutation for each __p.

    Rows change places within buckets of a hash, so that no task orders all rows.
    """
    own = rows.select(identifier, "__x", F.pmod(F.xxhash64(F.col(identifier)), F.lit(buckets)).alias("__b"))
    placed = own.select(identifier, "__b", F.row_number().over(Window.partitionBy("__b").orderBy(identifier)).alias("__n"))
    each = F.explode(F.array(*map(F.lit, range(permutations)))).alias("__p")
    order = Window.partitionBy("__p", "__b").orderBy(F.xxhash64(F.col(identifier), F.col("__p")), identifier)
    moved = own.select(identifier, "__b", "__x", each).select("__p", "__b", "__x", F.row_number().over(order).alias("__n"))
    return placed.join(moved, ["__b", "__n"]).select(identifier, "__p", "__x")


def permutation_importance(model: PipelineModel, test: DataFrame, columns: list[str] | None, label: str, identifier: str, permutations: int = 5, buckets: int = 64) -> DataFrame:
    """feature, slot, r2_drop, r2_sd, mae_rise, mae_sd of every slot of the model's vector, or of those of ``columns``: means
    and deviations over permutations of the slot's values.

    All slots and permutations are scored by one job: a row meets its partner of each permutation once, and copies of its
    vector with one slot taken from the partner are made, scored and summed up in place.
    """
    slots = slots_of(model, test)
    tried = [k for k, (feature, _) in enumerate(slots) if columns is None or feature in columns]
    ready = PipelineModel(model.stages[:-1]).transform(test).select(identifier, F.col(label).cast("double").alias("__y"), vector_to_array("features").alias("__own"))
    met = ready.join(partners(ready.withColumnRenamed("__own", "__x"), identifier, permutations, buckets), identifier)
    # slot -1 is the vector as it is
    swapped = F.transform(F.array(*(F.lit(k) for k in [-1, *tried])), lambda s: F.struct(s.alias("slot"), F.transform("__own", lambda v, k: F.when(k == s, F.get("__x", k)).otherwise(v)).alias("v")))
    each = met.select("__y", "__p", F.explode(swapped).alias("s")).select("__y", "__p", "s.slot", array_to_vector("s.v").alias("features"))
    error = F.col("__y") - F.col("prediction")
    sums = model.stages[-1].transform(each).groupBy("slot", "__p").agg(F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("sse"), (F.var_pop("__y") * F.count("__y")).alias("sst"))
    # a row for each slot and permutation from here on
    measured = sums.select("slot", "__p", "mae", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r2"))
    whole = measured.where("slot = -1").select("__p", F.col("mae").alias("mae_whole"), F.col("r2").alias("r2_whole"))
    gone = measured.where("slot >= 0").join(whole, "__p").select("slot", (F.col("r2_whole") - F.col("r2")).alias("drop"), (F.col("mae") - F.col("mae_whole")).alias("rise"))
    means = gone.groupBy("slot").agg(F.avg("drop").alias("r2_drop"), F.stddev_pop("drop").alias("r2_sd"), F.avg("rise").alias("mae_rise"), F.stddev_pop("rise").alias("mae_sd"))
    names = test.sparkSession.createDataFrame([(k, *n) for k, n in enumerate(slots)], "k int, feature string, name string")
    return means.join(F.broadcast(names), F.col("slot") == F.col("k")).select("feature", F.col("name").alias("slot"), "r2_drop", "r2_sd", "mae_rise", "mae_sd")
