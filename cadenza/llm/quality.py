"""Quality scores from learned hashed word and character n-gram vectors (a linear text classifier).

A document is the mean of the vectors of its features: each word, the character n-grams of the word between marks, and
each pair of neighbouring words, twice: by the words themselves, and by their shapes and whether they are the same word.
A softmax layer follows; both are trained by numpy stochastic gradient descent in one task, on a bounded sample of
labelled rows (``most``), so that the driver holds nothing but the model. As the layers are linear, a feature needs only
its share of the score when documents are scored: a word's share is computed once per worker and block, and whole texts
are scored in one pass without a shuffle.

Defined results: null and empty texts, and texts of white space only, get the score of the bias alone; repeated rows get
equal scores; an empty table gives an empty result; without labelled rows, or with one class only, every score is 0.5
or that of the bias; very long texts are scored whole, a block of their own; all other columns of the input stay, one
named as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.sampling import in_one_task
from cadenza.llm.sentencepiece_codec import WordIndex, with_columns

WORDS = re.compile(r"[^ \t-\r]+")
BUCKETS, DIM, GRAMS = 1 << 18, 10, (3, 4)
CACHE_WORDS = 300_000
SHAPE_BITS = 9


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' features, the word that each belongs to, and each word's shape and hash."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = lengths + 2
    ends = np.cumsum(size)
    marked = np.zeros(int(ends[-1]), np.uint64)
    inner = np.ones(len(marked), bool)
    inner[ends - size] = inner[ends - 1] = False
    marked[inner] = codes + np.uint64(2)
    marked[ends - 1] = 1
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(marked)) - np.repeat(ends - size, size)
    prime = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(int(size.max()), 0x100000001B3, np.uint64))
    whole = np.add.reduceat((marked + np.uint64(7)) * prime * powers[place], ends - size)
    found, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        if len(marked) < n:
            continue
        gram = np.full(len(marked) - n + 1, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x100000001B3) + marked[k : k + len(gram)]
        fits = owner[n - 1 :] == owner[: len(gram)]
        found.append(gram[fits] * prime)
        owners.append(owner[: len(gram)][fits])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    buckets ^= buckets >> np.uint64(29)
    buckets = ((buckets * prime) >> np.uint64(46)).astype(np.int64)
    shape = np.zeros(len(words), np.int64)
    start = np.cumsum(lengths) - lengths
    upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 192) & (codes <= 222))
    letter = upper | ((codes >= 97) & (codes <= 122)) | (codes >= 223)
    digit = (codes >= 48) & (codes <= 57)
    other = ~letter & ~digit
    for bit, kind in enumerate((upper, letter & ~upper, digit, other)):
        shape |= np.logical_or.reduceat(kind, start).astype(np.int64) << bit
    shape |= (np.add.reduceat(other.astype(np.int64), start) > 1).astype(np.int64) << 4
    shape |= np.minimum(lengths // 6, 7) << 5
    return buckets, owners, shape, whole


def pair_buckets(shapes: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Buckets of each pair of neighbours, by words and by shapes (two columns), for all but the last word."""
    same = (words[1:] == words[:-1]).astype(np.int64)
    by_shape = ((same << 2 * SHAPE_BITS | shapes[:-1] << SHAPE_BITS | shapes[1:]) * 2654435761 & 0xFFFFFFFF) % SHAPE_PAIRS
    code = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] >> np.uint64(7)) ^ hashes[1:]
    by_word = ((code * np.uint64(0x100000001B3)) >> np.uint64(40)).astype(np.int64) % WORD_PAIRS
    return np.stack([BUCKETS + by_word, BUCKETS + WORD_PAIRS + by_shape], axis=1)


SHAPE_PAIRS, WORD_PAIRS = BUCKETS // 4, BUCKETS
KEPT_TOGETHER = 64  # documents whose features lie side by side
TOTAL = BUCKETS + WORD_PAIRS + SHAPE_PAIRS


def train(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the score, and the bias."""
    rng = np.random.default_rng(seed)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def keep() -> None:
        """Lays the features of some documents side by side: half as large, and given back whole after the training."""
        buckets, shares = np.concatenate([b for b, _ in held]).astype(np.int32), np.concatenate([s for _, s in held]).astype(np.float32)
        ends = np.cumsum([len(b) for b, _ in held]).tolist()
        docs.extend((buckets[a:b], shares[a:b]) for a, b in zip([0, *ends], ends, strict=False))
        held.clear()

    for text in texts:
        if len(held) == KEPT_TOGETHER:
            keep()
        words = WORDS.findall(text)
        if not words:
            held.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        distinct = list(dict.fromkeys(words))
        number = {w: k for k, w in enumerate(distinct)}
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        times = np.bincount(at, minlength=len(distinct))
        buckets, owners, shape, hashes = word_features(distinct)
        pairs = pair_buckets(shape[at], hashes[at], at).ravel()
        every = np.concatenate([buckets, pairs])
        weight = np.concatenate([times[owners], np.ones(len(pairs), np.int64)])
        unique, inverse = np.unique(every, return_inverse=True)
        share = np.bincount(inverse, weights=weight)
        held.append((unique, share / share.sum()))
    if held:
        keep()
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (TOTAL, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    out += rng.uniform(-0.1, 0.1, out.shape)
    truth = np.eye(2)[np.asarray(labels, np.int64)] if labels else np.zeros((0, 2))
    if len(set(labels)) < 2:
        return np.zeros(TOTAL), 0.0 if not labels else (2.0 if labels[0] else -2.0)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)).tolist():
            buckets, share = docs[k]
            pace = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            gap = p / p.sum() - truth[k]
            back = gap @ out
            out -= pace * np.outer(gap, hidden)
            bias -= pace * gap
            vectors[buckets] -= (pace * len(buckets) ** 0.5) * share[:, None] * back
    way = out[1] - out[0]
    return vectors @ way, float(bias[1] - bias[0])


class Scorer:
    def __init__(self, shares: np.ndarray, bias: float):
        self.shares, self.bias = shares, bias
        self.reset()

    def reset(self) -> None:
        self.index, self.sums, self.counts, self.shapes, self.hashes = WordIndex(), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.reset()
        lists = [WORDS.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        if self.index.new:
            buckets, owners, shape, hashes = word_features(self.index.new)
            self.sums = np.concatenate([self.sums, np.bincount(owners, weights=self.shares[buckets], minlength=len(shape))])
            self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=len(shape))])
            self.shapes, self.hashes = np.concatenate([self.shapes, shape]), np.concatenate([self.hashes, hashes])
            self.index.new = []
        doc = np.repeat(np.arange(len(lists)), sizes)
        total = np.bincount(doc, weights=self.sums[at], minlength=len(lists))
        count = np.bincount(doc, weights=self.counts[at], minlength=len(lists))
        if len(at) > 1:
            inside = doc[1:] == doc[:-1]
            pairs = self.shares[pair_buckets(self.shapes[at], self.hashes[at], at)[inside]].sum(axis=1)
            total += np.bincount(doc[1:][inside], weights=pairs, minlength=len(lists))
            count += 2 * np.bincount(doc[1:][inside], minlength=len(lists))
        logit = np.where(count > 0, total / np.maximum(count, 1), 0.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> tuple[np.ndarray, float]:
    """``labels``: (doc_id, label 0 or 1); of a document's repeated labels the least counts, null ones don't."""
    known = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, truth = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column("text").to_pylist()]
            truth += batch.column("label").to_pylist()
        shares, bias = train(texts, [int(y) for y in truth])
        yield pa.RecordBatch.from_arrays([pa.array([shares.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["shares", "bias"])

    found = in_one_task(docs, known, most).mapInArrow(run, "shares binary, bias double").collect()  # one row of a fixed size
    return (np.frombuffer(found[0]["shares"]), found[0]["bias"]) if found else train([], [])


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1 by the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float64), model[1]))  # TOTAL numbers: a fixed size

    def run(texts: Iterator[list[str | None]]) -> Iterator[list[pa.Array]]:
        scorer = Scorer(*shared.value)
        for block in texts:
            yield [pa.array(scorer.score(block))]

    return with_columns(docs, text_col, run, {out: "double"})


def fold(buckets: int) -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string")) % buckets
