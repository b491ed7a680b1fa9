"""The corpus pipeline: stages of training-data preparation, each written as Parquet and read again by the next.

Stages, all over whole texts and all rows that the stage before kept: documents of low quality go; of each group of near
duplicates (five-word shingles, similarity 0.8) the row with the least id stays; documents that hold a benchmark passage
(up to a fifth of its words edited) go; personal data is replaced by marks; texts are encoded to token ids and decoded.
Rows with a null text count as empty texts in every stage; each row is decided by itself, by a key that a stage gives it,
so ids may repeat or be null (in a group a row without an id comes last, and of equal ids one row stays); an empty table
passes through empty. The columns of ``documents``, extra ones included, stay; the last stage gives the decoded text and adds
``ids`` and ``n_tokens``, in place of columns of those names. ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, near_dedup, pii, quality, sentencepiece_codec
from cadenza.llm.common import fresh_path, materialize
from cadenza.llm.registry import tokenizer_path

LEAST_QUALITY = 0.2
ROW = "__row"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, written once so that every later read sees the same keys."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good is at least ``LEAST_QUALITY``: doubtful ones, such as very short texts, stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.with_score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group."""
    rows = with_row_key(docs)
    groups = near_dedup.groups(rows.select(F.col(ROW).alias("id"), "text")).select(F.col("id").alias(ROW), "component_id")
    joined = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = materialize(groups.join(joined, "component_id").join(rows.select(ROW, "doc_id"), ROW), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW))[ROW]
    kept = members.groupBy("component_id").agg(first.alias(ROW)).select(ROW)
    others = members.select(ROW).join(kept, ROW, "left_anti")
    return rows.join(others, ROW, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = with_row_key(docs)
    held = decontaminate.find_items(rows, benchmark, key=ROW).select(ROW).distinct()
    return rows.join(held, ROW, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with marks in place of personal data."""
    found = pii.with_spans(docs, out="__spans")
    clean = found.withColumn("text", F.when(F.size("__spans") > 0, pii.redacted(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the final texts, with the text that they decode to in place of the text."""
    own = tuple(c for c in docs.columns if c not in ("text", "n_tokens", "ids"))
    out = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), key_columns=own, out=("__ids", "__decoded"))
    return out.select(*own, F.col("__decoded").alias("text"), F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]

#: SQL has no trained classifier and no tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
