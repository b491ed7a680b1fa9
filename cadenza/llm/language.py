"""Language of whole texts by a small convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes. Filters of several widths run over each window, the maximum of
each filter over the window goes through a rectifier into a softmax layer; a text's probabilities are the means over its
windows, weighted by their bytes. The network is trained in numpy on the driver by stochastic gradient descent on a
bounded sample (``most`` documents, ``WINDOWS_EACH`` evenly spread windows of each); as its input is one byte out of 256,
a filter is a table of 256 numbers for each place, and a pass over a window adds up rows of those tables.

Defined results: ``und`` with score 0 for null texts and texts without a letter; if nothing was learned, ``und`` with
score 0 for all; ties go to the first language in order; repeated rows get equal results; an empty table an empty one;
very long texts are read whole, a chunk of windows at a time; all other columns of the input stay, those named as the
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.sampling import labelled_sample
from cadenza.llm.sentencepiece_codec import with_columns

WINDOW, WIDTHS, FILTERS, WINDOWS_EACH = 160, (2, 3, 4), 16, 4
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 128


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text's bytes, the last filled up with zeros, and how many bytes each has."""
    count = -(-len(raw) // WINDOW)
    cells = np.zeros(count * WINDOW, np.uint8)
    cells[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(count, WINDOW)
    if count:
        sizes[-1] = len(raw) - WINDOW * (count - 1)
    return cells.reshape(count, WINDOW), sizes


class Network:
    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _filtered(self, cells: np.ndarray, k: int) -> np.ndarray:
        table, span = self.tables[k], WINDOW - WIDTHS[k] + 1
        total = table[0].take(cells[:, :span], axis=0)
        for at in range(1, WIDTHS[k]):
            total += table[at].take(cells[:, at : at + span], axis=0)
        return total

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def probabilities(self, cells: np.ndarray) -> np.ndarray:
        found = [np.zeros((0, len(self.classes)), np.float32)]
        for a in range(0, len(cells), CHUNK):
            part = cells[a : a + CHUNK]
            pooled = np.concatenate([np.maximum(self._filtered(part, k).max(axis=1) + self.bias[k], 0) for k in range(len(WIDTHS))], axis=1)
            found.append(self._softmax(pooled))
        return np.concatenate(found)

    def train(self, cells: np.ndarray, truth: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.3, seed: int = 12) -> None:
        rng = np.random.default_rng(seed)
        wanted = np.eye(len(self.classes), dtype=np.float32)[truth]
        steps, done = epochs * -(-len(cells) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(cells))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                x, rows = cells[pick], np.arange(len(pick))
                pooled, tops = [], []
                for k in range(len(WIDTHS)):
                    z = self._filtered(x, k)
                    top = z.argmax(axis=1)
                    tops.append(top)
                    pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0] + self.bias[k])
                raw = np.concatenate(pooled, axis=1)
                hidden = np.maximum(raw, 0)
                gap = (self._softmax(hidden) - wanted[pick]) / len(pick)
                back = (gap @ self.out.T) * (raw > 0)
                pace = rate * (1 - done / steps)
                done += 1
                self.out -= pace * (hidden.T @ gap)
                self.out_bias -= pace * gap.sum(axis=0)
                for k, width in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    self.bias[k] -= pace * g.sum(axis=0)
                    for at in range(width):
                        byte = x[rows[:, None], tops[k] + at].astype(np.int64)
                        cell = byte * FILTERS + np.arange(FILTERS)
                        self.tables[k][at] -= pace * np.bincount(cell.ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        raws = [t.encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts]
        parts = [windows_of(r) for r in raws]
        counts = np.array([len(c) for c, _ in parts], np.int64)
        if not self.classes or not counts.sum():
            return ["und"] * len(texts), np.zeros(len(texts))
        p = self.probabilities(np.concatenate([c for c, _ in parts])).astype(np.float64) * np.concatenate([s for _, s in parts])[:, None]
        owner = np.repeat(np.arange(len(texts)), counts)
        means = np.stack([np.bincount(owner, weights=p[:, c], minlength=len(texts)) for c in range(len(self.classes))], axis=1)
        means /= np.maximum([len(r) for r in raws], 1)[:, None]
        best = means.argmax(axis=1)
        known = counts > 0
        return [self.classes[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, means[np.arange(len(best)), best], 0.0).clip(0, 1)


def fit(docs: DataFrame, labelled: DataFrame, most: int = 3000) -> Network:
    """``labelled``: (doc_id, label); the languages are those of the sample."""
    sample = labelled_sample(docs, labelled.where(F.col("label").isNotNull()), most)
    classes = sorted({y for _, y in sample})
    number = {y: k for k, y in enumerate(classes)}
    cells, truth = [np.zeros((0, WINDOW), np.uint8)], []
    for text, y in sample:
        found = windows_of(text.encode("utf-8", "replace"))[0] if LETTER.search(text) else cells[0]
        pick = np.unique(np.linspace(0, len(found) - 1, WINDOWS_EACH).round().astype(int)) if len(found) else []
        cells.append(found[pick] if len(found) else found)
        truth += [number[y]] * len(pick)
    network = Network(classes)
    if classes and truth:
        network.train(np.concatenate(cells), np.array(truth))
    return network


def with_language(docs: DataFrame, network: Network, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language of the whole text and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few tables of a fixed size

    def run(texts: Iterator[list[str | None]]) -> Iterator[list[pa.Array]]:
        for block in texts:
            names, scores = shared.value.predict(block)
            yield [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, text_col, run, {out[0]: "string", out[1]: "double"})
