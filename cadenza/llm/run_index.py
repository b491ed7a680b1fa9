"""A run-length index: the Burrows-Wheeler transform of many short strings, kept as runs with sampled ends.

Rows of the transform that start a run carry a sample: their text position, the position of the row before and how many
bytes both share. All other positions follow from the nearest sample on their left (one step to the right takes one from
the shared length and one to the neighbour), so matching statistics of the whole text stream out of the samples alone.
"""

from __future__ import annotations

import numpy as np

#: No byte of UTF-8: ends each string. Ends are ordered by their place in the text.
END = 255
WORD = 8


class RunIndex:
    """Index of strings (``bytes`` without ``END``), joined in the order given."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.starts = np.cumsum(sizes) - sizes
        #: Bytes from each position to the end of its string.
        self.rest = np.repeat(self.starts + sizes - 1, sizes) - np.arange(len(self.text))
        words = self._words()
        rows = self._order(words, int(sizes.max()))
        before = self.text[rows - 1]
        first = np.ones(len(rows), bool)
        first[1:] = (before[1:] != before[:-1]) | (before[1:] == END)
        heads = np.flatnonzero(first)
        self.runs = len(heads)
        place, above = rows[heads], rows[np.maximum(heads - 1, 0)]
        shared = self._shared(words, place, above)
        shared[heads == 0] = 0
        by_place = np.argsort(place)
        self.sampled, self.above, self.shared = place[by_place], above[by_place], shared[by_place]

    def _words(self) -> np.ndarray:
        """The next eight bytes of each position as one number; those after the string's end count as ends."""
        padded = np.concatenate([self.text, np.full(WORD, END, np.uint8)])
        word = np.zeros(len(self.text), np.uint64)
        for k in range(WORD):
            word = (word << np.uint64(8)) | padded[k : k + len(word)]
        beyond = np.clip(WORD - self.rest, 0, WORD).astype(np.uint64) * np.uint64(8)
        tail = np.where(beyond >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(beyond, np.uint64(63))) - np.uint64(1))
        return word | tail

    def _order(self, words: np.ndarray, longest: int) -> np.ndarray:
        """Positions by their suffixes, three times as many bytes a round (twice in large texts, whose ranks are too long
        for three in a key); equal suffixes of two strings by place."""
        order = np.argsort(words)
        rank, step = self._ranked(words, order), WORD
        bits, ranks = (21, 3) if len(rank) <= 1 << 21 else (31, 2)
        while step < longest:
            key = rank
            for further in range(step, ranks * step, step):
                key = key << np.int64(bits)
                key[:-further] |= np.where(self.rest[:-further] >= further, rank[further:], 0)
            order = np.argsort(key)
            rank, step = self._ranked(key, order), ranks * step
            if rank.max() == len(rank) - 1:
                return order
        return np.argsort((rank << np.int64(32)) | np.arange(len(rank)))

    @staticmethod
    def _ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank, sorted_ = np.empty(len(key), np.int64), key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        return rank

    def _shared(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes have in common, up to the nearer end."""
        most = np.minimum(self.rest[a], self.rest[b])
        shared, live, done = most.copy(), np.arange(len(a)), 0
        while len(live):
            live = live[most[live] > done]
            x = words[a[live] + done] ^ words[b[live] + done]
            same = np.full(len(live), WORD)
            for k in range(WORD, 0, -1):  # the highest byte that differs comes first in the text
                same[(x >> np.uint64(64 - 8 * k)) != 0] = k - 1
            ended = same < WORD
            shared[live[ended]] = np.minimum(most[live[ended]], done + same[ended])
            live, done = live[~ended], done + WORD
        return shared

    def statistics(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """For the text positions first .. last - 1: the neighbour in the transform's order, and the bytes shared with it."""
        at = np.arange(first, last)
        sample = np.searchsorted(self.sampled, at, "right") - 1
        gone = at - self.sampled[sample]
        return self.above[sample] + gone, self.shared[sample] - gone

    def repeated(self, least: int, block: int = 1 << 18) -> np.ndarray:
        """Whether the ``least`` bytes from each position also start at an earlier one."""
        size = len(self.text)
        leader = np.arange(size)
        for a in range(0, size, block):
            near, shared = self.statistics(a, min(a + block, size))
            leader[a : a + block] = np.where(shared >= least, near, leader[a : a + block])
        while True:  # neighbours of neighbours, until each position names the first row of those that share its bytes
            further = leader[leader]
            if np.array_equal(further, leader):
                break
            leader = further
        earliest = np.full(size, size)
        np.minimum.at(earliest, leader, np.arange(size))
        return np.arange(size) > earliest[leader]
