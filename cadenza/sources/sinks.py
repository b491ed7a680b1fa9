"""Writing: idempotent appends, rebuilds, model versions."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.dataset import promoted

VERSIONS = "version string, sequence long, digest string, size_bytes long, mae double, baseline_mae double, metrics string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """Where driver and executors both reach: the checkpoint folder, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once where all tasks read it, and read back: what follows doesn't compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_new(fresh: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks, one for each key (the least row by all columns)."""
    rest = [c for c in fresh.columns if c != key]
    one_each = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*") if rest else fresh.distinct()
    return one_each.join(target.select(key), key, "left_anti").select(*fresh.columns)


def read_or_empty(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """The table at a path, an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_new(fresh: DataFrame, path: str, key: str) -> None:
    """Safe to repeat: rows that are there already are not written again."""
    only_new(fresh, read_or_empty(fresh.sparkSession, path, fresh.schema), key).write.mode("append").parquet(path)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(fresh: DataFrame, path: str, key: str, buckets: int = 64) -> list[int]:
    """New keys are added, known ones replaced, in a table of hash buckets; which buckets were written anew.

    ``fresh``: one row for each key, written down or cheap to read again. Only buckets in which a row really changes are
    rewritten (dynamic partition overwrite); all others keep their files, so a repeated run writes nothing. A table keeps
    the number of buckets that it began with, as its folders' names depend on it.
    """
    spark, columns = fresh.sparkSession, fresh.columns
    dealt = fresh.withColumn("bucket", bucket_of(key, buckets))
    old = read_or_empty(spark, path, dealt.schema)
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
    near = old.where(F.col("bucket").isin(touched))
    # a column is compared as it is, null with null
    rows = dealt.select(key, "bucket", F.struct(*columns).alias("__new")).join(near.select(key, F.struct(*columns).alias("__old")), key, "left")
    changed = sorted(r.bucket for r in rows.where(~F.col("__new").eqNullSafe(F.col("__old"))).select("bucket").distinct().collect())
    if changed:
        own = dealt.where(F.col("bucket").isin(changed))
        kept = old.where(F.col("bucket").isin(changed)).join(own.select(key), key, "left_anti")
        merged = kept.select(*columns, "bucket").unionByName(own).repartition("bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return changed


def append_bucketed(fresh: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> None:
    """As ``append_new``, for a bucketed table: looking for known keys shuffles the fresh rows alone, not the table."""
    spark = fresh.sparkSession
    exists = spark.catalog.tableExists(name)
    rows = only_new(fresh, spark.table(name), key) if exists else only_new(fresh, fresh.limit(0), key)
    writer = rows.repartition(buckets, key).write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def artifact(spark: SparkSession, folder: str) -> tuple[str, int]:
    """SHA-256 over the digests of all files of a folder, and their bytes together; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    digests = F.array_sort(F.collect_list(F.sha2("content", 256)))  # a model is a few dozen files
    row = files.agg(F.sha2(F.array_join(digests, ","), 256).alias("digest"), F.sum("length").cast("long").alias("size")).first()
    return row["digest"], row["size"]


def create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of that name; says whether it did. Of several writers one succeeds."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # Hadoop looks and then creates there; a link is made or not
        own = target.toUri().getPath()
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(own), prefix=".") as draft:
            draft.write(text)
            draft.flush()
            try:
                os.link(draft.name, own)
            except FileExistsError:
                return False
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The entries of a ledger, in no order; one that is being written is not there yet."""
    rows = read_or_empty(spark, folder, "value string", "text")
    return rows.where("value <> ''").select(F.from_json("value", schema).alias("e")).select("e.*")


def commit(spark: SparkSession, folder: str, schema: str, make: Callable[[DataFrame, int], dict | None]) -> dict | None:
    """Adds the next numbered entry to a ledger, as ``make`` sees its state: (entries so far, number) to an entry or None.

    Another writer's entry of the same number makes it look again, so each entry was decided on all before it.
    """
    while True:
        known = entries(spark, folder, schema)
        number = known.count() + 1
        entry = make(known, number)
        if entry is None or create_only(spark, f"{folder}/{number:012d}", json.dumps(entry, sort_keys=True)):
            return entry


PROMOTIONS = "version string, at long"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All saved versions of a model, and which of them is current (the one promoted last)."""
    saved = entries(spark, f"{path}/versions", VERSIONS)
    last = entries(spark, f"{path}/promotions", PROMOTIONS).agg(F.max(F.struct("at", "version"))["version"].alias("last"))
    return saved.crossJoin(F.broadcast(last)).withColumn("is_current", F.coalesce(F.col("version") == F.col("last"), F.lit(False))).drop("last")


def current(spark: SparkSession, path: str):
    return versions(spark, path).where("is_current").first()


def save_model(spark: SparkSession, model, path: str, metrics: dict[str, float], baseline_mae: float | None = None) -> str:
    """A new version of a model: its files, their digest and size, its metrics. Returns the version's name."""
    version = uuid.uuid4().hex
    model.write().save(f"{path}/artifacts/{version}")
    digest, size = artifact(spark, f"{path}/artifacts/{version}")
    own = {"version": version, "digest": digest, "size_bytes": size, "mae": metrics.get("mae"), "baseline_mae": baseline_mae, "metrics": json.dumps(metrics, sort_keys=True)}
    commit(spark, f"{path}/versions", VERSIONS, lambda known, number: own | {"sequence": number})
    return version


def promote(spark: SparkSession, path: str, version: str) -> bool:
    """Makes a version the current one if it passes the gate and is not worse than the present one; says whether it did.

    One entry both lowers the present version and raises the new one, so there is never none or more than one; of two
    promotions at once the later one is measured against the version that the other has raised.
    """
    known = entries(spark, f"{path}/versions", VERSIONS).where(F.col("version") == version).first()
    if known is None:
        raise ValueError(f"no version {version}")
    if known["mae"] is None or known["baseline_mae"] is None:
        return False

    def decided(raised: DataFrame, number: int) -> dict | None:
        present = current(spark, path)
        better = promoted(known["mae"], known["baseline_mae"], present["mae"] if present else None)
        return {"version": version, "at": number} if better else None

    return commit(spark, f"{path}/promotions", PROMOTIONS, decided) is not None
