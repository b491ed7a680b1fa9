"""Interaction audit of filters: what each removes, in every order, from a packed bitmap index.

Facts of a document (which filters it fails, its labels) are found with built-in functions and written once, narrow. Each
batch of facts then becomes bitmaps, one bit for a document: one for each filter and label, and for each part the span
of bytes in which it has documents (rows are ordered by part, so that spans hardly overlap). For each set of filters
applied before, AND-NOT and popcount give what a next filter finds left; only these counts, summed over all partitions,
are left to reckon orders from. An order matters only through the set of its prefix: 2 ** n sets, not n! orders.

Defined results: null texts are empty, a null part is the empty string; copies are found over the whole table, a copy of a
smaller id counts, rows without an id or with the id of the first copy are none; labels that repeat an id count if any
row has the label; an empty table gives an empty result; texts are taken whole; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
#: Facts that become bitmaps at once.
BLOCK_ROWS = 1 << 16


def failures(text: Column, copy: Column) -> dict[str, Column]:
    """Letter to whether a text fails: short, repetitive, capitals, symbols, a copy."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": copy,
    }


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and the bits ``fails`` (of the filters, in order) and ``labelled`` (1: good, 2: toxic), a row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = failures(text, F.lit(False))
    bits = sum((F.when(fails[x], 1 << k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    own = materialize(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), bits.cast("int").alias("fails")), "facts")
    copied = own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * (1 << LETTERS.index("E"))
    labelled = F.coalesce(F.col("good").cast("int"), F.lit(0)) + 2 * F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return own.join(copied, "digest", "left").join(marks, "id", "left").select("part", F.col("fails").bitwiseOR(copy).cast("int").alias("fails"), labelled.cast("int").alias("labelled"))


def bitmap(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little")


COUNTS = "part string, before int, filter int, kept long, removed long, redundant long, good long, toxic long"


def counts(found: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """For each part, set of filters applied before (bits) and next filter: documents kept after it, removed by it, failing
    it but gone before, and removed ones with either label."""
    names = [f.split()[0] for f in COUNTS.split(", ")]
    states = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]

    def index(part: np.ndarray, fails: np.ndarray, labelled: np.ndarray) -> Iterator[list]:
        order = np.argsort(part, kind="stable")
        part, fails, labelled = part[order], fails[order], labelled[order]
        fail = np.array([bitmap(fails >> f & 1) for f in range(filters)])
        good, toxic = bitmap(labelled & 1), bitmap(labelled >> 1 & 1)
        gone = np.zeros((1 << filters, len(good)), np.uint8)  # documents that a set of filters removes
        for s in range(1, 1 << filters):
            low = (s & -s).bit_length() - 1
            gone[s] = gone[s & (s - 1)] | fail[low]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True):
            span = slice(a // 8, -(-b // 8))
            own = np.zeros(8 * (span.stop - span.start), bool)
            own[a - 8 * span.start : b - 8 * span.start] = True
            own = bitmap(own)
            for s, f in states:
                failing = own & fail[f, span]
                removed = failing & ~gone[s, span]
                kept = own & ~gone[s | 1 << f, span]
                yield [part[a], s, f, *(int(np.bitwise_count(x).sum()) for x in (kept, removed, failing & gone[s, span], removed & good[span], removed & toxic[span]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(a, BLOCK_ROWS)
                codes = block.column("part").dictionary_encode()
                texts = codes.dictionary.to_pylist()
                rows = index(codes.indices.to_numpy(), *(block.column(c).to_numpy() for c in ("fails", "labelled")))
                while some := list(itertools.islice(rows, 10_000)):
                    columns = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([texts[p] for p in columns[0]], pa.string()), *(pa.array(c, pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(columns[1:]))], names)

    summed = [F.sum(n).alias(n) for n in names[3:]]
    return found.mapInArrow(run, COUNTS).groupBy("part", "before", "filter").agg(*summed)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: the counts of ``counts``, what only its filter fails
    (``unique_fails``), and its filter's removals summed over all orders (``shapley``)."""
    n = len(LETTERS)
    orders = [("".join(o), k + 1, sum(1 << LETTERS.index(x) for x in o[:k]), LETTERS.index(o[k])) for o in itertools.permutations(LETTERS) for k in range(n)]
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int")  # n! * n rows, whatever the data
    found = counts(facts(docs, labels), n)
    size = F.bit_count("before")
    times = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)  # orders with this prefix
    each = Window.partitionBy("part", "filter")
    whole = found.withColumns({"unique_fails": F.sum(F.when(size == n - 1, F.col("removed"))).over(each), "shapley": F.sum(F.col("removed") * times).over(each)})
    named = whole.join(F.broadcast(steps), ["before", "filter"])
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
