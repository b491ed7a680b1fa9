"""Bounded samples of labelled rows, the same for the same rows whatever their partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_rows(docs: DataFrame, labelled: DataFrame, most: int, text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents of ``labelled`` (doc_id, label), chosen by a hash of the id.

    Only ids are ordered; the texts of the chosen ones, whose number is bounded by ``most``, come by a broadcast join.
    """
    chosen = labelled.orderBy(dealt(), "doc_id").limit(most)
    got = docs.select("doc_id", F.col(text_col).alias("__text")).join(F.broadcast(chosen), "doc_id")
    return got.groupBy("doc_id").agg(F.min("__text").alias("text"), F.min("label").alias("label"))


def dealt() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def labelled_sample(docs: DataFrame, labelled: DataFrame, most: int, text_col: str = "text") -> list[tuple[str, object]]:
    """(text, label) of the chosen documents, ordered by the hash, on the driver."""
    rows = chosen_rows(docs, labelled, most, text_col).orderBy(dealt(), "doc_id").select("text", "label").toArrow()
    return [(text or "", label) for text, label in zip(rows["text"].to_pylist(), rows["label"].to_pylist(), strict=True)]


def in_one_task(docs: DataFrame, labelled: DataFrame, most: int, text_col: str = "text") -> DataFrame:
    """(text, label) of the chosen documents, at most ``most``, in one task in the order of the hash: the driver sees no text."""
    return chosen_rows(docs, labelled, most, text_col).repartition(1).sortWithinPartitions(dealt(), "doc_id").select("text", "label")
