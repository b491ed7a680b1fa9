"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a block go into a trie, one character of all of them at a time. The forward score of a node,
the best sum of piece scores over all segmentations of the prefix that it stands for, and the number of tokens of that
segmentation are computed once for each node, thus once for each shared prefix; a pre-token's count is that of its
terminal node. Pieces are followed through a second trie, that of the vocabulary: each node keeps the states that its
last one, two, ... characters lead to. The trie is ``DEPTH`` characters deep, below which hardly any prefix is shared: longer
pre-tokens go on from the scores of their node there one by one, in time linear in their length.

Scores: the vocabulary's order gives Zipf log-probabilities, ``-ln(position + 2)``; a character that is in no piece is
one unknown unit with a score 10 below the least and counts as its UTF-8 bytes. Of equal scores that with fewer tokens
counts. Defined results: null and empty texts have no tokens; repeated rows get equal counts; an empty table an empty
result; pre-tokens of any length are handled whole; all other columns of the input stay, those named as the results are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.sentencepiece_codec import NORMAL, SPACE, PairTable, WordIndex, read_model, with_columns

CACHE_WORDS = 300_000
UNKNOWN_PENALTY = 10.0
DEPTH = 64


def unigram_scores(model_path: str) -> dict[str, float]:
    """Piece (with blanks for its space marks) to log-probability, by the vocabulary's order."""
    model = read_model(model_path)
    normal = [(-s, i, p) for i, (p, s, t) in enumerate(zip(model["pieces"], model["scores"], model["types"], strict=True)) if t == NORMAL]
    return {p.replace(SPACE, " "): -float(np.log(k + 2)) for k, (_, _, p) in enumerate(sorted(normal))}


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        states: dict[tuple[int, int], int] = {}
        value = [np.nan]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                nxt = states.get((at, ord(c)))
                if nxt is None:
                    nxt = states[(at, ord(c))] = len(value)
                    value.append(np.nan)
                at = nxt
            value[at] = score
        keys = np.array(list(states), np.int64)
        self.steps = PairTable(keys[:, 0], keys[:, 1], np.array(list(states.values()), np.int32)[:, None])
        self.value = np.array(value)
        self.next = {at << 21 | char: nxt for (at, char), nxt in states.items()}
        self.values = [None if v != v else v for v in value]  # of each state, where a piece ends
        self.words = re.compile(r" *[^ \n]+|\n| +")
        self.reset()

    def reset(self) -> None:
        self.index, self.tokens = WordIndex(), np.zeros(0, np.int64)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        result = np.zeros(len(words), np.int64)
        best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]  # by depth, then node
        node, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        states = np.full((1, 0), -1, np.int64)  # of each node at this depth: by how many characters, the vocabulary state
        above = np.zeros((1, 0), np.int64)  # and the node above by as many characters
        depth = 0
        while len(alive):
            if depth == DEPTH:
                for w in alive.tolist():
                    result[w] = self._alone(words[w], node[w], best, tokens, above)
                break
            key = node[alive] << 21 | codes[starts[alive] + depth]
            own, inverse = np.unique(key, return_inverse=True)
            parent, char = own >> 21, own & 0x1FFFFF
            depth += 1
            wide = min(depth, self.longest)
            before = np.concatenate([np.zeros((len(states), 1), np.int64), states], axis=1)[parent, :wide]
            above = np.concatenate([np.arange(len(above))[:, None], above], axis=1)[parent, :wide]
            states = np.full((len(own), wide), -1, np.int64)
            score = np.full(len(own), -np.inf)
            count = np.zeros(len(own), np.int64)
            for k in range(wide):
                at = np.flatnonzero(before[:, k] >= 0)
                if not len(at):
                    continue
                found = self.steps.find(before[at, k], char[at])
                states[at[found >= 0], k] = self.steps.values[found[found >= 0], 0]
                piece = self.value[np.maximum(states[at, k], 0)]
                ends = ~np.isnan(piece) & (states[at, k] >= 0)
                self._offer(at[ends], best[-1 - k][above[at[ends], k]] + piece[ends], tokens[-1 - k][above[at[ends], k]] + 1, score, count)
            alone = np.flatnonzero((states[:, 0] < 0) | np.isnan(self.value[np.maximum(states[:, 0], 0)]))
            size = 1 + (char[alone] > 0x7F) + (char[alone] > 0x7FF) + (char[alone] > 0xFFFF)
            self._offer(alone, best[-1][above[alone, 0]] + self.unknown, tokens[-1][above[alone, 0]] + size, score, count)
            best.append(score)
            tokens.append(count)
            if len(best) > self.longest:
                best.pop(0)
                tokens.pop(0)
            node[alive] = inverse
            over = lengths[alive] == depth
            result[alive[over]] = count[inverse[over]]
            alive = alive[~over]
        return result

    def _alone(self, word: str, node: int, best: list[np.ndarray], tokens: list[np.ndarray], above: np.ndarray) -> int:
        """Tokens of one word, from the scores of its last prefixes in the trie on."""
        known = [node, *above[node].tolist()][: len(best)]
        first = DEPTH + 1 - len(known)  # the shortest prefix whose score is at hand
        none = float("-inf")
        score, count = [none] * (len(word) - first + 1), [0] * (len(word) - first + 1)
        for back, at in enumerate(known):
            score[len(known) - 1 - back], count[len(known) - 1 - back] = float(best[-1 - back][at]), int(tokens[-1 - back][at])
        codes, follow, values, reached = list(map(ord, word)), self.next.get, self.values, DEPTH - first
        for start in range(len(word) - first):
            own, number, state, end = score[start], count[start] + 1, 0, start
            single = False
            while end + first < len(word):
                state = follow(state << 21 | codes[end + first])
                if state is None:
                    break
                end += 1
                piece = values[state]
                if piece is not None:
                    single |= end == start + 1
                    if end > reached and ((total := own + piece) > score[end] or (total == score[end] and number < count[end])):
                        score[end], count[end] = total, number
            if not single and start >= reached:
                char, total = codes[start + first], own + self.unknown
                size = number + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
                if total > score[start + 1] or (total == score[start + 1] and size < count[start + 1]):
                    score[start + 1], count[start + 1] = total, size
        return count[-1]

    @staticmethod
    def _offer(at: np.ndarray, total: np.ndarray, number: np.ndarray, score: np.ndarray, count: np.ndarray) -> None:
        better = (total > score[at]) | ((total == score[at]) & (number < count[at]))
        score[at[better]], count[at[better]] = total[better], number[better]

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        lists = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        if self.index.new:
            self.tokens = np.concatenate([self.tokens, self.count_words(self.index.new)])
            self.index.new = []
        total = np.bincount(np.repeat(np.arange(len(lists)), sizes), weights=self.tokens[at], minlength=len(lists))
        return total.astype(np.int64), sizes


def with_counts(docs: DataFrame, scores: dict[str, float], text_col: str = "text", out: tuple[str, str] = ("n_tokens", "n_pretokens")) -> DataFrame:
    """``docs`` with the number of tokens and of pre-tokens of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # one vocabulary, whatever the input's size

    def run(texts: Iterator[list[str | None]]) -> Iterator[list[pa.Array]]:
        counter = TrieCounter(shared.value)
        for block in texts:
            yield list(map(pa.array, counter.count(block)))

    return with_columns(docs, text_col, run, {out[0]: "long", out[1]: "long"})
