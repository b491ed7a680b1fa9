"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Audio is 16-bit mono PCM in a binary column. Overlapping frames are transformed and folded into twelve pitch classes;
sixteen rectangular filters over that image, each evaluated from an integral image in four look-ups, are quantised to
two Gray-coded bits and packed into one integer for each position. Two recordings align where a histogram of the offsets
between their equal integers peaks; the share of differing bits over the overlap at that offset says how well.

Equal integers in a row, as silence and held tones give, are one run. Two runs of an integer vote for all offsets between
any of their places; the votes rise, stay and fall, so four turns of the histogram's slope say it all, whatever the
lengths. The turns of a pair of recordings, summed up by offset, give the votes at every turn, and at the ends of the
offsets that overlap enough; between two turns votes are linear, so a peak lies on one, or fills all between two.

The search takes queries and all rows. Recordings with equal fingerprints form a class and are searched once; classes are
linked by integers that they share, so no pair is looked at that shares none. Offsets with too short an overlap don't
count in the histogram; all offsets at its peak are rated by their bit errors. Defined results: null, empty and too short
audio has an empty fingerprint, is a class of its own with the other such rows and aligns with nothing; of the offsets
at the peak that with the fewest bit errors counts, of equal ones the least absolute, then the least; repeated rows are
in one class, rows without a key in that of their fingerprint (none where no row of it has a key); an empty table gives
an empty result; long recordings are taken whole; further columns stay outside (``key`` is kept).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize

RATE, FRAME, LOW_HZ, HIGH_HZ = 5512, 2048, 80.0, 2000.0
HOP = FRAME // 3
SPAN = 16  # frames that a filter sees at most
CUTS = (-0.15, 0.0, 0.15)


def filters() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Sixteen pairs of areas (frame, pitch, frames, pitches) whose means are compared, made by one rule."""
    made = []
    for n in range(16):
        width, height, low = (4, 8, 12, 16)[n % 4], (2, 3, 4, 6)[n // 4], (n * 5) % 6
        half = width // 2
        if n % 2:  # earlier against later
            made.append(([(0, low, half, height)], [(half, low, half, height)]))
        else:  # lower against higher pitches
            made.append(([(0, low, width, height // 2)], [(0, low + height // 2, width, height - height // 2)]))
    return made


FILTERS = filters()


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy in twelve pitch classes for each frame, each frame scaled to length 1 (silent ones stay 0)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64) / 32768.0, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hamming(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = (hertz >= LOW_HZ) & (hertz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(hertz[heard] / 440.0)).astype(int) % 12
    image = power[:, heard] @ np.eye(12)[pitch]
    length = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(length > 1e-6, image / np.maximum(length, 1e-6), 0.0)


def packed(image: np.ndarray) -> np.ndarray:
    """One integer of 32 bits for each position from which ``SPAN`` frames can be seen."""
    count = len(image) - SPAN + 1
    if count <= 0:
        return np.zeros(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(count)

    def mean(areas: list[tuple[int, int, int, int]]) -> np.ndarray:
        summed, cells = np.zeros(count), 0
        for frame, pitch, frames, pitches in areas:
            a, b, top = at + frame, at + frame + frames, min(12, pitch + pitches)
            summed += total[b, top] - total[a, top] - total[b, pitch] + total[a, pitch]
            cells += frames * (top - pitch)
        return summed / cells

    code = np.zeros(count, np.uint32)
    for first, second in FILTERS:
        level = np.searchsorted(CUTS, np.round(np.log((1 + mean(first)) / (1 + mean(second))) * 4, 9))
        code = code << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)
    return code.view(np.int32)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    return packed(chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2"))) if pcm else np.zeros(0, np.int32)


def with_fingerprints(df: DataFrame, audio_col: str, key: str, to_pcm: Callable[[object], bytes] | None = None) -> DataFrame:
    """``key`` and ``fingerprint array<int>``. ``to_pcm`` turns a value of the column into PCM where it isn't that yet:
    decoded audio, many times as large, then never leaves the worker."""
    narrow = df.select(key, F.col(audio_col).alias("__audio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (x.as_py() for x in batch.column(1))
            found = [fingerprint(to_pcm(x) if to_pcm else x) for x in values]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            items = np.concatenate([*found, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(items, pa.int32()))], names=[key, "fingerprint"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, fingerprint array<int>")


def melody(vector: list[float] | None) -> bytes:
    """A vector played as one tone for each number, higher numbers as higher tones."""
    values = np.nan_to_num(np.array([v or 0.0 for v in vector or []], np.float64))
    if not len(values):
        return b""
    scaled = np.tanh(values / max(float(np.abs(values).mean()), 1e-9) / 2)
    hertz = 220.0 * 2 ** (np.round((scaled + 1) * 12) / 12)
    return (np.sin(2 * np.pi * hertz[:, None] * (np.arange(HOP) / RATE)).ravel() * 20000).astype("<i2").tobytes()


#: Of ``takes``: tones that a late take leaves out, tones that a short one has, and the noise of a noisy one.
LATE, SHORT, NOISE = 9, 40, 400


def takes(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, take, fingerprint): each vector played as ``melody``, whole (take 0) and once more: late, short or noisy, by a hash of the key."""
    narrow = table.select(F.col(key).alias("key"), F.pmod(F.xxhash64(F.col(key)), F.lit(3)).cast("int").alias("kind"), F.col(vector).alias("vector"))
    tone = 2 * HOP  # bytes

    def second(pcm: bytes, kind: int, seed: int) -> bytes:
        if kind == 0:
            return pcm[LATE * tone :]
        if kind == 1:
            return pcm[: SHORT * tone]
        sound = np.frombuffer(pcm, "<i2") + np.random.default_rng(seed & 0xFFFFFFFF).normal(0, NOISE, len(pcm) // 2)
        return sound.clip(-32768, 32767).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                keys, kinds, vectors = (c.to_pylist() for c in some.columns)
                whole = [melody(v) for v in vectors]
                other = [second(w, kind, i or 0) for w, kind, i in zip(whole, kinds, keys, strict=True)]
                columns = [pa.array([*keys, *keys], some.column(0).type), pa.array([0] * len(keys) + [1] * len(keys), pa.int32()), pa.array([fingerprint(x) for x in whole + other], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "take", "fingerprint"])

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, take int, fingerprint array<int>")


def align(prints: DataFrame, is_query: F.Column, key: str, most_errors: float = 0.2, least_overlap: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Members (key, class_id: least key with an equal fingerprint, n_frames) and links between classes.

    Links: (class_id, query_id, offset, bit_error_rate), a row for each class of the table and query class that it aligns
    with, other than itself; offset is the place in the class's recording at which the query's begins.
    """
    named = prints.withColumn("__print", F.sha2(F.concat_ws(",", F.col("fingerprint").cast("array<string>")), 256)).withColumn("__query", F.coalesce(is_query, F.lit(False)))
    named = materialize(named.select(F.col(key).alias("__key"), "fingerprint", "__print", "__query"), "prints")
    classes = named.groupBy("__print").agg(F.min("__key").alias("class_id"), F.max("__query").alias("query"), F.min("fingerprint").alias("fingerprint"))
    classes = materialize(classes.where("class_id IS NOT NULL"), "classes")
    sizes = classes.select("class_id", F.size("fingerprint").alias("own_size"))
    at = F.sequence(F.lit(0), F.size("fingerprint") - 1)
    begins = F.filter(at, lambda i: (i == 0) | (F.get("fingerprint", i) != F.get("fingerprint", i - 1)))
    marked = classes.where(F.size("fingerprint") > 0).select("class_id", "query", "fingerprint", begins.alias("begins"))
    run = F.transform("begins", lambda i, k: F.struct(F.get("fingerprint", i).alias("code"), i.alias("at"), (F.coalesce(F.get("begins", k + 1), F.size("fingerprint")) - i).alias("length")))
    runs = marked.select("class_id", "query", F.explode(run).alias("run")).select("class_id", "query", "run.*")
    asked_runs = runs.where("query").select(F.col("class_id").alias("query_id"), F.col("at").alias("query_at"), F.col("length").alias("query_length"), "code")
    met = runs.join(asked_runs, "code").where("class_id <> query_id")
    low = F.col("at") - F.col("query_at") - F.col("query_length")  # before the first offset
    a, b = F.least("length", "query_length"), F.greatest("length", "query_length")
    turns = F.array(F.struct(low.alias("offset"), F.lit(1).alias("turn")), F.struct((low + a).alias("offset"), F.lit(-1).alias("turn")), F.struct((low + b).alias("offset"), F.lit(-1).alias("turn")), F.struct((low + a + b).alias("offset"), F.lit(1).alias("turn")))
    pair = ["class_id", "query_id"]
    slopes = met.select(*pair, F.explode(turns).alias("t")).groupBy(*pair, F.col("t.offset").alias("offset")).agg(F.sum("t.turn").alias("turn"))
    # the offsets of a pair with enough overlap; their ends turn nothing
    bounds = slopes.select(*pair).distinct().join(sizes, "class_id").join(sizes.withColumnsRenamed({"class_id": "query_id", "own_size": "asked_size"}), "query_id")
    bounds = bounds.select(*pair, "own_size", "asked_size", (F.lit(least_overlap) - F.col("asked_size")).alias("least"), (F.col("own_size") - least_overlap).alias("most")).where("least <= most AND own_size >= {0} AND asked_size >= {0}".format(int(least_overlap)))
    ends = bounds.select(*pair, F.explode(F.array_distinct(F.array("least", "most"))).alias("offset"), F.lit(0).cast("long").alias("turn"))
    events = slopes.join(bounds.select(*pair), pair, "left_semi").unionByName(ends).groupBy(*pair, "offset").agg(F.sum("turn").alias("turn"))
    so_far = Window.partitionBy(*pair).orderBy("offset")
    sloped = events.withColumn("slope", F.sum("turn").over(so_far)).withColumn("next", F.lead("offset").over(so_far))
    risen = F.coalesce(F.sum(F.col("slope") * (F.col("next") - F.col("offset"))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    voted = sloped.withColumn("votes", risen).join(bounds, pair).where(F.col("offset").between(F.col("least"), F.col("most")) & (F.col("votes") > 0))
    peaks = voted.groupBy(*pair).agg(F.max("votes").alias("peak"))
    # a level stretch at the peak: all its offsets
    last = F.when(F.col("slope") == 0, F.least("most", F.coalesce(F.col("next") - 1, F.col("offset")))).otherwise(F.col("offset"))
    level = voted.join(peaks, pair).where("votes = peak").withColumn("offset", F.explode(F.sequence("offset", last)))
    overlap = F.least(F.col("own_size") - F.greatest(F.lit(0), F.col("offset")), F.col("asked_size") + F.least(F.lit(0), F.col("offset")))
    found = level.select(*pair, "offset", overlap.alias("size")).where(F.col("size") >= least_overlap)
    own = classes.select("class_id", F.col("fingerprint").alias("own"))
    asked = classes.where("query").select(F.col("class_id").alias("query_id"), F.col("fingerprint").alias("asked"))
    both = found.join(own, "class_id").join(asked, "query_id")
    one = F.slice("own", F.greatest(F.lit(0), F.col("offset")) + 1, F.col("size"))
    other = F.slice("asked", F.greatest(F.lit(0), -F.col("offset")) + 1, F.col("size"))
    low = F.lit(0xFFFFFFFF).cast("long")  # bit_count widens to 64 bits and would count a sign's copies
    wrong = F.aggregate(F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(low))), F.lit(0), lambda a, x: a + x)
    rated = both.select("class_id", "query_id", "offset", (wrong / (32 * F.col("size"))).alias("bit_error_rate"))
    best = F.min(F.struct("bit_error_rate", F.abs("offset").alias("near"), "offset"))
    links = rated.groupBy("class_id", "query_id").agg(best.alias("best")).select("class_id", "query_id", "best.offset", "best.bit_error_rate").where(F.col("bit_error_rate") <= most_errors)
    members = named.select(F.col("__key").alias(key), "__print", F.size("fingerprint").alias("n_frames")).join(classes.select("__print", "class_id"), "__print", "left")
    return members.select(key, "class_id", "n_frames"), links
