"""Exact search with pruning: the index in cells around some of its own vectors, of which whole cells are passed over.

An angle between unit vectors obeys the triangle inequality: nothing in a cell of radius ``r`` around ``c`` comes nearer to
a seed ``q`` than ``angle(q, c) - r``. A first pass over the cells nearest to each seed gives it a score that its last
neighbour reaches at least; a second pass multiplies a cell with those seeds alone that the bound lets reach that score.
Results equal those of ``similarity.neighbours``; how much is passed over depends on how far the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.operators.similarity import BOOST, MOST_SEEDS, SLACK as SCORE_SLACK, Lists, _asked, _dealt, _mode, found_schema, matrix, ranked_lists, with_facts
from cadenza.sources.sinks import written

#: Most cells, so that centres and their products with a part of the seeds stay small on the driver and in a task.
MOST_CELLS = 1024
#: For rounding of angles, in radians.
SLACK = 1e-6


@dataclass
class Cells:
    """``members``: the index with ``cell``, in order of cells; centres (unit vectors), radii (angles) and sizes by cell."""

    members: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _angles(units: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of vectors with centres; a vector of length 0 has a cosine of 0 with everything, a right angle."""
    scaled = np.divide(units, lengths[:, None], out=np.zeros_like(units), where=lengths[:, None] > 0)
    return np.arccos(np.clip(scaled @ centres.T, -1, 1))


def build(index: DataFrame, cells: int = 256) -> Cells:
    """``index`` (id, unit, length and further columns) in at most ``cells`` cells, around items picked by a hash of their ids."""
    cells = min(cells, MOST_CELLS)
    picked = index.where("length > 0").orderBy(F.xxhash64("id"), "id").limit(cells).select("unit", "length").toArrow()
    units = matrix(picked["unit"], picked.num_rows)
    centres = units / picked["length"].to_numpy()[:, None] if picked.num_rows else np.zeros((1, 0))
    schema = StructType([*index.schema.fields]).add("cell", "integer").add("angle", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, length = matrix(batch.column("unit"), batch.num_rows), batch.column("length").to_numpy()
            angles = _angles(own, length, centres) if centres.size else np.full((batch.num_rows, 1), np.pi / 2)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])], schema.fieldNames())

    # a cell of many items is dealt to several tasks, by id
    dealt = index.mapInArrow(run, schema).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell")
    members = written(dealt, "cells")
    known = members.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toArrow()
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    radii[known["cell"].to_numpy()], sizes[known["cell"].to_numpy()] = known["radius"].to_numpy(), known["n"].to_numpy()
    return Cells(members, centres, radii, sizes)


def _searched(cells: Cells, held: pa.Table, wanted: np.ndarray, floors: np.ndarray, top_n: int, mode: str, boost: float, only: list[int] | None, asked: DataFrame) -> DataFrame:
    """The best of each task's cells for the seeds that ``wanted`` [cell, seed] names, from ``floors`` (by seed) up."""
    spark = cells.members.sparkSession
    shared = spark.sparkContext.broadcast((held, np.packbits(wanted, axis=1), floors))
    rows = cells.members if only is None else cells.members.where(F.col("cell").isin(only))
    schema = found_schema(asked, cells.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, packed, least = shared.value
        lists = Lists(seeds, top_n, mode, boost, least)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cell)], strict=True):
                lists.meet(batch.slice(a, b - a), np.flatnonzero(np.unpackbits(packed[cell[a]], count=seeds.num_rows)))
        yield from lists.rows(schema.names)

    return rows.select("id", "genre", "is_imputed", "unit", "length", "cell").mapInArrow(run, schema)


def neighbours(seeds: DataFrame, cells: Cells, top_n: int, mode: str = "off", boost: float = BOOST) -> tuple[DataFrame, float]:
    """The best ``top_n`` of each seed by score, then id, ranked; and the share of products that was passed over.

    Seeds go in parts of at most ``MOST_SEEDS``; of a part the driver holds the vectors, their angles with the centres and
    the scores to be reached.
    """
    _mode(mode, boost)
    asked = _asked(seeds)
    lists, made, all_ = [], 0, 0
    for part in _dealt(asked, seeds.count(), MOST_SEEDS):
        held = part.orderBy("seed_id").toArrow()
        count, number = held.num_rows, len(cells.centres)
        # the cosine of a vector without length is 0, whatever the cell
        units, lengths = matrix(held["seed_unit"], count), held["seed_length"].to_numpy()
        near = _angles(units, lengths, cells.centres) if count and cells.centres.size else np.full((count, number), np.pi / 2)
        bound = np.cos(np.maximum(near - cells.radii - SLACK, 0)) + (boost if mode == "boost" else 0.0)
        bound[lengths == 0] = np.inf
        order = np.argsort(near, axis=1)
        enough = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order] <= top_n  # the nearest cells, until they hold more
        first = np.zeros((number, count), bool)
        first[order[enough], np.nonzero(enough)[0]] = True
        floors = np.full(count, -np.inf)
        near_cells = np.flatnonzero(first.any(axis=1)).tolist()
        found = _searched(cells, held, first, floors, top_n, mode, boost, near_cells, asked).select("seed_id", "id", "score")
        place = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score"), F.asc("id")))
        last = found.withColumn("place", place).where(F.col("place") == top_n).select("seed_id", "score").toArrow()
        floors[np.searchsorted(held["seed_id"].to_numpy(), last["seed_id"].to_numpy())] = last["score"].to_numpy() - SCORE_SLACK
        wanted = (bound >= floors[:, None] - SCORE_SLACK).T & (cells.sizes > 0)[:, None]
        made += int((wanted.sum(axis=1) * cells.sizes).sum()) + int((first.sum(axis=1) * cells.sizes).sum())
        all_ += count * int(cells.sizes.sum())
        lists.append(_searched(cells, held, wanted, floors, top_n, mode, boost, None, asked))
    ranked = ranked_lists(reduce(DataFrame.unionByName, lists), top_n)
    return with_facts(ranked, asked, cells.members.drop("cell", "angle")), max(0.0, 1 - made / all_) if all_ else 0.0
