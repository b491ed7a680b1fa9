"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a block of texts lie in one flat numpy array of symbols. In each round every word finds its
smallest pair rank by a segmented minimum, all leftmost non-overlapping pairs of that rank merge at once, and the array
is compacted; words without a mergeable pair leave it. A round in which a merge would make a pair that ranks no later
than the present one merges only the leftmost pair of that word, so that the result equals one merge at a time.

Defined results: null and empty texts give no ids and decode to the empty text. Characters without a piece give their
UTF-8 bytes as byte pieces. Repeated rows give repeated results, an empty table an empty one; further columns are kept
by the caller through ``key_columns``.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
#: Characters handled at once, and words kept between blocks; both bound a worker's memory, neither changes a result.
BLOCK_CHARS, CACHE_WORDS = 1_000_000, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def read_model(path: str) -> dict:
    """Pieces, scores, types of a model file. Only what the encoder needs is supported; anything else raises."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, scores, types = [], [], []
    byte_fallback = False
    dummy_prefix, extra_removed, escaped, charsmap = True, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            entry = dict(_fields(value))
            pieces.append(entry.get(1, b"").decode())
            scores.append(entry.get(2, 0.0))
            types.append(entry.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            byte_fallback = bool(spec.get(35, 0))
            if spec.get(3, 1) != 2 or spec.get(24, 0):
                raise ValueError("only BPE models with leading whitespace marks are supported")
        elif number == 3:
            spec = dict(_fields(value))
            charsmap = spec.get(2, b"")
            dummy_prefix, extra_removed, escaped = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    if charsmap or extra_removed or not escaped or not byte_fallback or {USER_DEFINED, UNUSED} & set(types):
        raise ValueError("only identity normalisation with byte fallback is supported")
    return {"pieces": pieces, "scores": scores, "types": types, "dummy_prefix": dummy_prefix}


class PairTable:
    """(left, right) -> value by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        bits = max(8, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros((1 << bits, values.shape[1]), np.int32)
        keys = (left.astype(np.int64) << 32) | right
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), values.tolist(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot] = key
            self.values[slot] = value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots, -1 where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        seen = self.keys[slots]
        found = np.where(seen == keys, slots, -1)
        rest = np.flatnonzero((seen != keys) & (seen != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            seen = self.keys[slots[rest]]
            hit = seen == keys[rest]
            found[rest[hit]] = slots[rest[hit]]
            rest = rest[~hit & (seen != -1)]
        return found


class WordIndex(dict):
    """Numbers words as they first appear; ``new`` has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Codec:
    """Encoder and decoder of one model; built once in each worker from ``read_model``'s plain lists."""

    def __init__(self, model: dict):
        pieces, types = [p.replace(SPACE, " ") for p in model["pieces"]], model["types"]
        self.n = len(pieces)
        self.prefix = " " if model["dummy_prefix"] else ""
        normal = {p: i for i, p in enumerate(pieces) if types[i] == NORMAL}
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p}):
            symbols.setdefault(char, len(pieces) + len(symbols))  # never an id: above all of them
        scores = np.asarray(model["scores"])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        left, right, values = [], [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in symbols and b in symbols:
                    left.append(symbols[a])
                    right.append(symbols[b])
                    values.append((order[scores[i]], i))
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(values, np.int32))
        chars = sorted({c for p in normal for c in p})
        self.dense = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.symbol_of = np.full(len(chars) + 1, -1, np.int32)
        for k, c in enumerate(chars, 1):
            self.dense[ord(c)] = k
            self.symbol_of[k] = symbols[c]
        self.inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # pairs of characters that some piece joins
        for p in normal:
            for a, b in zip(p, p[1:]):
                self.inside[self.dense[ord(a)], self.dense[ord(b)]] = True
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if types[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append(b"" if types[i] == CONTROL else " ⁇ ".encode() if types[i] == UNKNOWN else p.encode())
        self.silent = {i for i in range(self.n) if types[i] == CONTROL}
        self.spaced = {i for p, i in normal.items() if p[0] == " "}
        alone = "".join(re.escape(c) for c in "\n\t\r" if not self.dense[ord(c)])
        self.words = re.compile(rf" *[^ {alone}]+|[{alone}]| +" if alone else r" *[^ ]+| +")
        joined = any(re.search("[^ ] ", p) for p in normal)
        if joined:
            raise ValueError("a piece runs over the start of a word")
        self.reset()

    def reset(self) -> None:
        self.cache = WordIndex()
        self.flat: list[np.ndarray] = []
        self.sizes: list[int] = []

    # -- encoding

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.reset()
        lists = [self.words.findall(self.prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        at = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if self.cache.new:
            ids, counts = self._encode_words(self.cache.new)
            self.cache.new = []
            self.flat = [np.concatenate([*self.flat, ids])]
            self.sizes = [np.concatenate([*self.sizes, counts])]
        if not self.flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        ids = self.flat[0][np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        marks = np.concatenate([[0], ends])
        last = np.cumsum([len(words) for words in lists])
        return ids, np.diff(marks[np.concatenate([[0], last]).astype(np.int64)])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        dense = self.dense[codes]
        # a segment ends where no piece holds the two characters side by side
        edge = np.ones(len(codes), bool)
        edge[1:] = (word[1:] != word[:-1]) | ~self.inside[dense[:-1], dense[1:]]
        segment = np.cumsum(edge, dtype=np.int32) - 1
        symbols = self.symbol_of[dense]
        symbols = np.where(symbols < 0, -1 - codes, symbols)
        place = np.arange(len(codes), dtype=np.int32)
        done_symbols, done_place = [], []
        lone = np.bincount(segment)[segment] == 1
        done_symbols.append(symbols[lone])
        done_place.append(place[lone])
        symbols, place, segment = symbols[~lone], place[~lone], segment[~lone]
        ranks, made = self._ranks(symbols, segment)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sizes = np.diff(np.append(starts, len(segment)))
            least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = least == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_place.append(place[over])
                go = ~over
                symbols, place, segment, ranks, made, least = (x[go] for x in (symbols, place, segment, ranks, made, least))
                if not len(symbols):
                    break
            mergers = ranks == least
            first = mergers & ~np.concatenate([[False], mergers[:-1]])
            at = np.arange(len(mergers))
            run = np.maximum.accumulate(np.where(first, at, -1))
            mergers &= (at - run) % 2 == 0
            merged = self._merge(symbols, place, segment, ranks, made, least, mergers)
            if merged is None:
                where = np.flatnonzero(mergers)
                keep = np.concatenate([[True], segment[where][1:] != segment[where][:-1]])
                careful = np.isin(segment[where], self.early)
                mergers[where[careful & ~keep]] = False
                merged = self._merge(symbols, place, segment, ranks, made, least, mergers, check=False)
            symbols, place, segment, ranks, made = merged
        symbols, place = np.concatenate(done_symbols), np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        symbols, owner = symbols[order], word[place[order]]
        unknown = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        if len(unknown):
            back = {v: k for k, v in enumerate(self.symbol_of.tolist()) if v >= self.n}
            chars = np.flatnonzero(self.dense) if back else None
            ids, owners, last = [], [], 0
            for u in unknown.tolist():
                s = int(symbols[u])
                char = chr(-1 - s) if s < 0 else chr(int(chars[np.flatnonzero(self.dense[chars] == back[s])[0]]))
                raw = np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)
                ids += [symbols[last:u], self.byte_ids[raw]]
                owners += [owner[last:u], np.full(len(raw), owner[u])]
                last = u + 1
            symbols, owner = np.concatenate([*ids, symbols[last:]]), np.concatenate([*owners, owner[last:]])
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _ranks(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol with its right neighbour: the pair's rank and the piece that it makes."""
        ranks = np.full(len(symbols), NO_RANK, np.int32)
        made = np.full(len(symbols), -1, np.int32)
        if len(symbols) > 1:
            at = np.flatnonzero(segment[1:] == segment[:-1])
            self._look(symbols[at], symbols[at + 1], at, ranks, made)
        return ranks, made

    def _look(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        found = self.pairs.find(left, right)
        hit = found >= 0
        ranks[at], made[at] = NO_RANK, -1
        values = self.pairs.values[found[hit]]
        ranks[at[hit]], made[at[hit]] = values[:, 0], values[:, 1]

    def _merge(self, symbols, place, segment, ranks, made, least, mergers, check=True):
        """None if, in a segment with several merges, one would make a pair that ranks no later than the present."""
        where = np.flatnonzero(mergers)
        after = symbols.copy()
        after[where] = made[where]
        kept = np.ones(len(symbols), bool)
        kept[where + 1] = False
        several = np.zeros(len(where), bool)
        same = segment[where][1:] == segment[where][:-1]
        several[1:] |= same
        several[:-1] |= same
        if check and several.any():
            w = where[several]
            right = w[(w + 2 < len(symbols))]
            right = right[segment[right + 2] == segment[right]]
            found = self.pairs.find(after[right], symbols[right + 2])  # before its own merge
            early = [segment[right][(found >= 0) & (self.pairs.values[found, 0] <= least[right])]]
            left = w[w > 0]
            before = np.where(kept[left - 1], left - 1, left - 2)
            fits = (before >= 0) & (segment[np.maximum(before, 0)] == segment[left])
            left, before = left[fits], before[fits]
            found = self.pairs.find(after[before], after[left])
            early.append(segment[left][(found >= 0) & (self.pairs.values[found, 0] <= least[left])])
            self.early = np.unique(np.concatenate(early))
            if len(self.early):
                return None
        touched = np.zeros(len(symbols), bool)
        touched[where] = True
        symbols, place, segment, ranks, made, touched = (x[kept] for x in (after, place, segment, ranks, made, touched))
        touched[:-1] |= touched[1:]
        at = np.flatnonzero(touched)
        ranks[at], made[at] = NO_RANK, -1
        at = at[at + 1 < len(symbols)]
        at = at[segment[at + 1] == segment[at]]
        self._look(symbols[at], symbols[at + 1], at, ranks, made)
        return symbols, place, segment, ranks, made

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        if not self.silent.isdisjoint(ids):  # a control piece parts the bytes beside it
            marks = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(marks, marks[1:])]
            text = "".join(b"".join(map(self.bytes_of.__getitem__, r)).decode("utf-8", "one_by_one") for r in runs)
        else:
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "one_by_one")
        if self.prefix and next((i for i in ids if i not in self.silent), None) in self.spaced:
            text = text[1:]
        return text


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Offsets and texts of a batch, a bounded number of characters at a time (a longer text is a block of its own)."""
    texts, first, size = [], 0, 0
    for k, text in enumerate(batch.column(column)):
        text = text.as_py()
        if texts and size + len(text or "") > most:
            yield first, texts
            texts, first, size = [], k, 0
        texts.append(text)
        size += len(text or "")
    if texts:
        yield first, texts


def with_columns(docs: DataFrame, text_col: str, work: Callable[[Iterator[list[str | None]]], Iterator[list[pa.Array]]], out: dict[str, str]) -> DataFrame:
    """``docs`` with the columns that ``work`` gives for each block of texts; columns of the same names are replaced.

    ``out``: name and type of each result.
    """
    clashing = {c.lower() for c in out}
    kept = [f for f in docs.schema.fields if f.name.lower() not in clashing]
    narrow = docs.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for batch in batches:
                for first, block in blocks(batch, "text"):
                    held.append(batch.slice(first, len(block)))
                    yield block

        for found in work(texts()):
            part = held.pop(0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=names)

    schema = StructType(narrow.schema.fields[:-1])
    for i, kind in enumerate(out.values()):
        schema.add(f"o{i}", kind)
    names = schema.fieldNames()
    return narrow.mapInArrow(run, schema).toDF(*(f.name for f in kept), *out)


_codecs: dict[int, Codec] = {}


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", key_columns: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """``key_columns`` with the ids of the whole text (array<int>), and the text that those ids stand for, named by ``out``."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))  # one vocabulary, whatever the input's size
    token = hash(model_path)
    narrow = df.select(*(F.col(f"`{c}`") for c in key_columns), F.col(text_col).alias("__text"))

    def run(batches):
        codec = _codecs.get(token) or _codecs.setdefault(token, Codec(model.value))
        for batch in batches:
            for first, texts in blocks(batch, "__text"):
                ids, counts = codec.encode(texts)
                ends = np.cumsum(counts)
                flat = ids.tolist()
                decoded = [codec.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in key_columns), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                    names=[*key_columns, *out],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{fields}, `{out[0]}` array<int>, `{out[1]}` string")
