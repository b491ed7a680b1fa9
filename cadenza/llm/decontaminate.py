"""Benchmark passages in documents, up to a share of edited words.

Documents and items are sequences of lower-cased words. A document holds an item if some stretch of it is within
``floor((1 - similarity) * words)`` word edits of the item. Windows of an item's size are embedded by a CGK random walk
(a random bit for each step and word says whether the walk stays or advances), which turns few edits into few differing
places; repeated samples of the embedding's places make the LSH keys, ``REPEATS`` of them. Windows that share a key with an
item, and no others, are verified by exact edit distance against every stretch around them.

The longer an item is, the less the walks of its edited copies agree. So the number of places in a key is chosen for each
size of items: copies of the items are edited as much as is allowed, half by substitutions alone, both are walked, and
the most places are taken with which at least ``TARGET`` of such copies share a key (at most ``SAMPLES``, at least one).

Windows are taken at every word of the whole text. A window is embedded only where it can match at all: an edit changes
at most two pairs of neighbouring words, so a stretch within t edits of an item of n words holds n - 1 - 2t of the
items' word pairs or more; counting those pairs loses nothing. Items so short for the allowed edits that no pair need
stay are counted by words, of which n - t stay. ``exact`` takes the same count for each single item too, and verifies
where it reaches the item's number whether a key is shared or not: no passage is missed then, for more work.

Defined results: null and empty texts and items hold nothing; items are read in blocks of ``BLOCK_WORDS`` words, so that
any number of them fits a worker; of repeated items each id is reported; repeated documents are reported each; for a
pair the least distance counts, of equal ones the first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.sentencepiece_codec import PairTable, blocks

WORD = re.compile(r"\w+")
SAMPLES, REPEATS, STRETCH, BLOCK_WORDS = 6, 32, 3, 500_000
TARGET, TRIALS = 0.99, 32  # of copies at the largest allowed distance that are to share a key, and copies tried for a size
WINDOWS, CELLS = 1024, 1 << 16  # walked at once: windows, and words of theirs (a longer window is walked alone)
COUNTED = 4_000_000  # places of pairs by item that are counted at once
SCHEMA = "item_id long, word_start long, word_end long, distance int, item_words int"
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between the item and any stretch of the text, and that stretch (the first that ends first)."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    for symbol in item.tolist():
        down, across = cost + 1, cost[:-1] + (text != symbol)
        step, origin = down.copy(), start.copy()
        better = across < down[1:]
        step[1:][better], origin[1:][better] = across[better], start[:-1][better]
        # a run of skipped text words: the least of step - place so far, plus the place
        order = step - at
        low = np.minimum.accumulate(order)
        first = np.maximum.accumulate(np.where(order == low, at, 0))
        first = np.where(order == low, at, first)
        cost, start = low + at, origin[first]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def least_distance(item: list[int], text: list[int]) -> int:
    """That distance alone, a text word at a time for all words of the item at once, as bits of an integer."""
    size, at = len(item), {}
    for k, symbol in enumerate(item):
        at[symbol] = at.get(symbol, 0) | 1 << k
    every, last = (1 << size) - 1, 1 << size - 1
    more, less = every, 0  # where the cost rises and falls along the item
    cost = best = size
    for symbol in text:
        equal = at.get(symbol, 0)
        level = (((equal & more) + more) ^ more) | equal | less
        up, down = less | ~(level | more) & every, level & more
        cost += bool(up & last) - bool(down & last)
        best = min(best, cost)
        up, down = up << 1 & every, down << 1 & every
        more, less = down | ~(level | up) & every, up & level
    return best


class Finder:
    """The items of one block, and what of them is needed to find them."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, seed: int = 5, exact: bool = True, samples: dict[int, int] | None = None):
        self.exact = exact
        self.items = [(i, w) for i, w in items if w]
        vocabulary = sorted({w for _, ws in self.items for w in ws})
        self.number = {w: k for k, w in enumerate(vocabulary, 1)}
        self.symbols = [np.array([self.number[w] for w in ws], np.int64) for _, ws in self.items]
        self.most = [int((1 - similarity) * len(s) + 1e-9) for s in self.symbols]
        self.by_size: dict[tuple[int, int], int] = {}
        for k, s in enumerate(self.symbols):
            self.by_size.setdefault((len(s), self.most[k]), len(self.by_size))
        pairs: dict[tuple[int, int], set[int]] = defaultdict(set)  # to the sizes of the items that hold them
        for k, s in enumerate(self.symbols):
            for pair in zip(s[:-1].tolist(), s[1:].tolist()):
                pairs[pair].add(self.by_size[len(s), self.most[k]])
        known = np.array(sorted(pairs) or [(-1, -1)], np.int64)
        marks = np.zeros((len(known), len(self.by_size) // 31 + 2), np.int32)
        marks[:, -1] = np.arange(len(known))
        for row, pair in enumerate(sorted(pairs)):
            for size in pairs[pair]:
                marks[row, size // 31] |= 1 << size % 31
        self.pairs = PairTable(known[:, 0], known[:, 1], marks)
        rows = {pair: row for row, pair in enumerate(sorted(pairs))}
        self.pair_items = self._postings([(rows[pair], k) for k, s in enumerate(self.symbols) for pair in set(zip(s[:-1].tolist(), s[1:].tolist()))])
        self.word_sizes = np.zeros((len(vocabulary) + 1, len(self.by_size)), bool)
        for k, s in enumerate(self.symbols):
            self.word_sizes[s, self.by_size[len(s), self.most[k]]] = True
        self.word_items = self._postings([(w, k) for k, s in enumerate(self.symbols) if len(s) - 1 - 2 * self.most[k] <= 0 for w in set(s.tolist())])
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(1, 2**32, (REPEATS, 1)).astype(np.uint32)
        sizes = sorted({len(x) for x in self.symbols})
        self.width = {n: max(m for m in sizes if self._class(m) == self._class(n)) for n in sizes}
        self.places = {n: rng.integers(0, STRETCH * n, (REPEATS, SAMPLES)) for n in sizes}
        self.samples = samples or {n: self._places_for(n, seed) for n in sizes}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sorted keys of each repeat, and their items
        for n in sizes:
            own = [k for k, x in enumerate(self.symbols) if len(x) == n]
            got = []
            for part in self._dealt(own, self.width[n]):
                windows = np.zeros((len(part), self.width[n]), np.int64)
                windows[:, :n] = np.stack([self.symbols[k] for k in part])
                got.append(self.sampled(*self.walk(windows), n, np.arange(len(part))))
            got = np.concatenate(got, axis=1)
            order = np.argsort(got, axis=1, kind="stable")
            self.keys[n] = np.take_along_axis(got, order, axis=1), np.array(own)[order]

    def _places_for(self, n: int, seed: int) -> int:
        """The most places of a key with which copies at the largest allowed distance are found as often as wanted."""
        rng = np.random.default_rng([seed, n])
        own = [(s, m) for s, m in zip(self.symbols, self.most, strict=True) if len(s) == n]
        windows = np.zeros((2 * TRIALS, self.width[n]), np.int64)
        for k in range(TRIALS):
            item, most = own[k % len(own)]
            windows[2 * k, :n] = item
            copy = item.tolist()
            for at in rng.permutation(n)[:most].tolist() if k % 2 else rng.integers(0, n, most).tolist():
                kind = 0 if k % 2 else int(rng.integers(0, 3))
                at = min(at, len(copy))
                copy[at : at + (kind != 1)] = [0] * (kind != 2)  # another word in place, one more, one less
            windows[2 * k + 1, : min(n, len(copy))] = copy[:n]
        agreed = []
        for part in self._dealt(windows, self.width[n]):
            shown, place = self.walk(part if len(part) % 2 == 0 else np.repeat(part, 2, axis=0))
            word = np.where(place[: STRETCH * n] < n, shown[: STRETCH * n], 0)
            agreed.append((word[:, :, ::2] == word[:, :, 1::2]).mean(axis=0))
        agreed = np.concatenate(agreed, axis=1)
        for count in range(SAMPLES, 1, -1):
            if (1 - np.prod(1 - agreed**count, axis=0)).mean() >= TARGET:
                return count
        return 1

    @staticmethod
    def _class(n: int) -> int:
        """Items up to 64 words are walked together, longer ones with those of up to twice their length."""
        return max(6, (n - 1).bit_length())

    @staticmethod
    def _dealt(windows: Sequence, width: int) -> Iterator[Sequence]:
        """As many windows at once as memory is meant for: what a walk keeps grows with their words together."""
        each = max(1, min(WINDOWS, CELLS // width))
        return (windows[a : a + each] for a in range(0, len(windows), each))

    def _postings(self, entries: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of (pair or word, size), and beside each an item of that size that holds it."""
        what, items = np.array(entries or np.zeros((0, 2)), np.int64).T
        sizes = np.array([self.by_size[len(s), m] for s, m in zip(self.symbols, self.most, strict=True)], np.int64)
        codes = what * len(self.by_size) + sizes[items]
        order = np.argsort(codes, kind="stable")
        return codes[order], items[order]

    def counted(self, here: np.ndarray, what: np.ndarray, owner: np.ndarray, postings: tuple[np.ndarray, np.ndarray], number: int, need: int, span: int) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first place, last place) of each ``need`` places in a row, at most ``span`` apart, that one item has.

        ``here``: places in the text, ascending; ``what``: the pair or word there.
        """
        codes, items = postings
        low, high = (np.searchsorted(codes, what * len(self.by_size) + number, side) for side in ("left", "right"))
        total = np.cumsum(high - low)
        # cut only where no such row of places can reach across
        cuts = np.flatnonzero((np.diff(here) > span) | (owner[here[1:]] != owner[here[:-1]])) + 1
        first = 0
        while first < len(here):
            within = np.searchsorted(total, COUNTED + (total[first - 1] if first else 0), "right")
            later = cuts[np.searchsorted(cuts, first, "right") :]
            fit = later[: np.searchsorted(later, within, "right")]
            end = len(here) if within >= len(here) else int(fit[-1]) if len(fit) else int(later[0]) if len(later) else len(here)
            times = high[first:end] - low[first:end]
            at = np.repeat(here[first:end], times)
            item = items[np.repeat(low[first:end] - np.cumsum(times) + times, times) + np.arange(len(at))]
            order = np.argsort(item, kind="stable")
            at, item = at[order], item[order]
            a, b = at[: max(0, len(at) - need + 1)], at[need - 1 :]
            same = (item[: len(a)] == item[need - 1 :]) & (b - a <= span) & (owner[a] == owner[b])
            yield from zip(owner[a[same]].tolist(), item[: len(a)][same].tolist(), a[same].tolist(), b[same].tolist(), strict=True)
            first = end

    def walk(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each repeat, step and window, the word that the walk shows and its place in the window.

        A walk doesn't depend on the item's size, which only says where it ends: one walk serves all sizes of a class.
        """
        longest = windows.shape[1]
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.int64)], axis=1).astype(np.uint32).ravel()
        steps = STRETCH * longest
        shown = np.zeros((steps, REPEATS, len(windows)), np.uint32)
        place = np.zeros((steps, REPEATS, len(windows)), np.uint8 if longest < 255 else np.int32)
        rows, pointer = np.arange(len(windows), dtype=np.int32) * (longest + 1), np.zeros((REPEATS, len(windows)), np.int32)
        for step in range(steps):
            symbol = padded.take(rows + pointer)
            shown[step], place[step] = symbol, pointer
            mixed = (symbol * ODD + np.uint32(step * 0x85EBCA6B & 0xFFFFFFFF)) ^ self.salts
            mixed ^= mixed >> np.uint32(15)
            pointer += ((mixed * ODD) >> np.uint32(31)).astype(np.int32)
            np.minimum(pointer, longest, out=pointer)
        return shown, place

    def sampled(self, shown: np.ndarray, place: np.ndarray, n: int, mine: np.ndarray) -> np.ndarray:
        """Keys of the windows ``mine`` as windows of n words, a row for each repeat."""
        each = np.arange(REPEATS)
        keys = np.zeros((REPEATS, len(mine)), np.uint64)
        for k in range(self.samples[n]):
            spot = self.places[n][:, k][:, None], each[:, None], mine
            symbol = np.where(place[spot] < n, shown[spot], 0).astype(np.uint64)
            keys = (keys ^ symbol) * MIX + np.uint64(k)
        return keys

    def find(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item id, first word, word after the last, distance, words of the item) for all that documents hold."""
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        size = int(lengths.sum())
        if not size or not self.items:
            return []
        text = np.fromiter(map(self.number.get, chain.from_iterable(docs), repeat(0)), np.int64, size)
        limits = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(docs)), lengths)
        last = limits[owner]  # of each word the end of its document
        at = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0) & (owner[1:] == owner[:-1]))
        slot = self.pairs.find(text[at], text[at + 1])
        at, marks = at[slot >= 0], self.pairs.values[slot[slot >= 0]]
        regions: dict[tuple[int, int], set[int]] = defaultdict(set)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        wanted: dict[tuple[int, int], np.ndarray] = {}
        for (n, most), number in self.by_size.items():
            need, reach, wide = n - 1 - 2 * most, n + most, 2
            if need > 0:
                mine = marks[:, number // 31] >> number % 31 & 1 > 0
                here = at[mine]  # places of word pairs of items of this size
            else:
                need, wide = max(1, n - most), 1
                here = np.flatnonzero(self.word_sizes[text, number] & (text > 0))
            # a window that holds ``need`` of them starts at most ``reach`` before the last of some ``need`` in a row
            close = np.flatnonzero(here[need - 1 :] - here[: len(here) - need + 1] <= reach - wide) if len(here) >= need else here[:0]
            ends = here[close + need - 1] + wide
            spread = np.zeros(size + 1, np.int32)
            np.add.at(spread, np.maximum(ends - reach, 0), 1)
            np.add.at(spread, here[close] + 1, -1)
            starts = np.flatnonzero(np.cumsum(spread[:-1]) > 0) if len(close) else close
            inside = np.searchsorted(here, np.minimum(starts + reach, last[starts]) - wide + 1) - np.searchsorted(here, starts)
            wanted[n, most] = starts = starts[inside >= need]
            if not self.exact:
                continue
            before = np.searchsorted(starts, here, "right") - 1
            close = (before >= 0) & (starts[before] >= here - reach + wide) if len(starts) else np.zeros(len(here), bool)
            if wide == 2:
                hits = self.counted(here[close], marks[mine, -1][close].astype(np.int64), owner, self.pair_items, number, need, reach - 2)
            else:
                hits = self.counted(here[close], text[here[close]], owner, self.word_items, number, need, reach - 1)
            self._add(regions, hits, wide, reach, limits - lengths)
        for width in sorted(set(self.width.values())):
            near_by = {size: near for size, near in wanted.items() if self.width[size[0]] == width}
            padded = np.concatenate([text, np.zeros(width, np.int64)])
            for part in self._dealt(np.unique(np.concatenate(list(near_by.values()))), width):
                reach = part[:, None] + np.arange(width)
                shown, place = self.walk(np.where(reach < last[part][:, None], padded[reach], 0))
                for (n, most), near in near_by.items():
                    mine = np.flatnonzero(np.isin(part, near, assume_unique=True))
                    if len(mine):
                        self._keyed(self.sampled(shown, place, n, mine), part[mine], n, most, owner, regions)
        for (doc, k), places in regions.items():
            n, most, low = len(self.symbols[k]), self.most[k], int(limits[doc] - lengths[doc])
            spots = np.array(sorted(places))
            spots = spots[spots + n <= limits[doc]]
            equal = np.flatnonzero((text[spots[:, None] + np.arange(n)] == self.symbols[k]).all(axis=1)) if len(spots) else spots
            same = int(spots[equal[0]]) if len(equal) else None
            if same is not None:  # a window without an edit always shares its keys, so no earlier one is overlooked
                best[doc, k] = (0, same - low, same - low + n)
                continue
            for a, b in self._merged(sorted(places), n, most, low, int(limits[doc])):
                if int(np.isin(text[a:b], self.symbols[k]).sum()) < n - most:  # fewer of its words than any such stretch keeps
                    continue
                if least_distance(self.symbols[k].tolist(), text[a:b].tolist()) > most:
                    continue
                distance, x, y = best_stretch(self.symbols[k], text[a:b])
                found = (distance, a + x - low, a + y - low)
                if distance <= most and ((doc, k) not in best or found < best[doc, k]):
                    best[doc, k] = found
        return [(doc, self.items[k][0], a, b, d, len(self.symbols[k])) for (doc, k), (d, a, b) in sorted(best.items())]

    def _keyed(self, keys: np.ndarray, starts: np.ndarray, n: int, most: int, owner: np.ndarray, regions: dict[tuple[int, int], set[int]]) -> None:
        """The starts of windows that share a key with an item."""
        known, items = self.keys[n]
        for r in range(REPEATS):
            low, high = (np.searchsorted(known[r], keys[r], side) for side in ("left", "right"))
            for w in np.flatnonzero(high > low).tolist():
                start = int(starts[w])
                for k in items[r, low[w] : high[w]].tolist():
                    if self.most[k] == most:
                        regions[int(owner[start]), k].add(start)

    @staticmethod
    def _add(regions: dict[tuple[int, int], set[int]], hits: Iterator[tuple[int, int, int, int]], width: int, reach: int, least: np.ndarray) -> None:
        """The first and the last start of a stretch that holds a hit; their surroundings overlap, so they cover all between."""
        for doc, k, first, last in hits:
            regions[doc, k].update((max(last + width - reach, int(least[doc])), first))

    @staticmethod
    def _merged(places: list[int], n: int, most: int, least: int, limit: int) -> Iterator[tuple[int, int]]:
        """Stretches around windows, overlapping ones as one."""
        low = high = -1
        for p in places:
            a, b = max(least, p - most), min(limit, p + n + 2 * most)
            if high > a:
                high = max(high, b)
                continue
            if high >= 0:
                yield low, high
            low, high = a, b
        if high >= 0:
            yield low, high


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text_col: str = "text", key: str = "doc_id", exact: bool = False) -> DataFrame:
    """A row for each document and item that it holds: the key, item_id, the stretch in words, edit distance, item's words.

    Of ``docs`` only the key and the text are read; a key named like a column of the result is refused.
    """
    if key.lower() in {f.split()[0] for f in SCHEMA.split(", ")}:
        raise ValueError(f"a key must not be named {key}")
    spark = docs.sparkSession
    parts: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if size and size + len(words) > BLOCK_WORDS:
            parts.append([])
            size = 0
        parts[-1].append((row["item_id"], words))
        size += len(words)
    narrow = docs.select(key, F.col(text_col).alias("__text"))
    kind = narrow.schema[0].dataType.simpleString()

    def against(items: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((items, Finder(items, similarity, exact=exact).samples))  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, samples = shared.value
            finder = Finder(block, similarity, exact=exact, samples=samples)
            for batch in batches:
                for first, texts in blocks(batch, "__text"):
                    rows = [(first + k, *hit) for k, *hit in finder.find([words_of(text) for text in texts])]
                    at, *columns = zip(*rows, strict=True) if rows else [[]] * 6
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, types)], names=[key, *(f.split()[0] for f in SCHEMA.split(", "))])

        return narrow.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")

    return reduce(DataFrame.unionByName, map(against, parts))
