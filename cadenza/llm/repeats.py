"""Long repeated passages: every byte covered by ``least`` bytes that also start earlier, found by run-length indexes.

Each window of ``least`` bytes has an anchor: the least hash among its k-byte pieces. Equal windows have equal anchors
wherever they stand, so a text is cut into stretches, runs of windows with one anchor, and only stretches with an anchor in
common can repeat one another. A document whose whole text an earlier one has is repeated as a whole and goes no further:
whatever repeats it repeats the earlier one too. For the others:

1. ``stretches``: anchor, digest and place of each stretch. Of equal ones within a block of texts one stands for all.
2. ``sift``: stretches by anchor. Those equal to an earlier one are repeated as a whole and need no text; anchors that
   occur once or in a single content are done. Only first occurrences of contents that may share windows are left.
3. Their bytes are cut from the texts and go to the tasks of their anchors, where a run-compressed Burrows-Wheeler
   transform with sampled run ends (``run_index.RunIndex``) is built of whole anchors at a time; matching statistics,
   streamed from its samples, mark windows that an earlier stretch has too.
4. Marks of a document are joined and cut out of its text.

Anchors that very many stretches share are dealt out by digest in 2, and in 3 window by window under hashes of their own,
so no anchor has to fit one task. A hashed part of the texts is counted to find them; that only directs rows.

Defined results: null texts are empty; rows are ordered by id, those without an id come last; rows that share an id (or
have none) follow one another by a hash of the text, and rows equal in both are one document, whose result each of them
gets; texts shorter than ``least`` bytes stay whole; an empty table gives an empty result; texts are taken whole,
whatever their length; further columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialize
from cadenza.llm.run_index import RunIndex

LEAST = 100
#: Bytes of text that a task hashes, or indexes, at once (one longer text is taken alone).
BLOCK_BYTES, INDEX_BYTES = 4 << 20, 1 << 18
#: Bytes of pieces that are looked through at once (an anchor with more is taken whole), and rows that then go on at once.
SEEN_BYTES, MOST_ROWS = 4 << 20, 10_000
#: Most windows of one stretch, and of one run.
MOST_WINDOWS, MOST_RUN = 256, 30_000
#: Positions that are reckoned at once, so that what is between stays in a processor's cache.
CHUNK = 1 << 14
#: One of so many texts is counted to find anchors with at least so many stretches there, the most frequent ones first.
HOT_SHARE, HOT_COUNT, MOST_HOT, HOT_PARTS = 16, 256, 500_000, 64
FIRST, COPY, HOT, INNER = 0, 1, 2, 3
NO_ID = 2**63 - 1
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * PRIME
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def piece_size(least: int) -> int:
    """Bytes of an anchor: a quarter of a window, in words of eight."""
    return 8 * max(1, least // 32) if least >= 8 else least


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash for the ``size`` bytes from each position."""
    count = len(data) - size + 1
    if size < 8:
        word = np.zeros(count, np.uint64)
        for k in range(size):
            word = (word << np.uint64(8)) | data[k : k + count]
        return mixed(word)
    raw, codes = data.tobytes(), np.empty(count, np.uint64)
    for a in range(0, count, CHUNK):
        n = min(CHUNK, count - a)
        words = np.ndarray((n + size - 8,), np.uint64, buffer=raw, offset=a, strides=(1,)).copy()
        code = mixed(words[:n])
        for k in range(8, size, 8):
            code = mixed(code * np.uint64(31) ^ words[k : k + n])
        codes[a : a + n] = code
    return codes


def anchors(hashes: np.ndarray, pieces: int, chosen: np.ufunc = np.minimum) -> np.ndarray:
    """The anchor of the window from each position: the least (or another choice) of so many hashes."""
    count = len(hashes) - pieces + 1
    found = np.empty(count, hashes.dtype)
    for a in range(0, count, CHUNK):
        so_far, width = hashes[a : min(a + CHUNK, count) + pieces - 1], 1
        while 2 * width <= pieces:
            so_far, width = chosen(so_far[:-width], so_far[width:]), 2 * width
        found[a : a + CHUNK] = chosen(so_far[: width - pieces], so_far[pieces - width :]) if pieces > width else so_far
    return found


def cut(data: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of joined texts: (place, windows, anchor, inner); ``sizes``: of the texts; ``inner``: the anchor is there
    more than once, so that windows of the same stretch may be equal."""
    ends = np.cumsum(sizes)
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    size = piece_size(least)
    hashes, pieces = piece_hashes(data, size), least - size + 1
    anchor = anchors(hashes, pieces)
    tails = np.minimum(sizes, least - 1)  # where no window begins
    inside = np.repeat(np.tile([True, False], len(sizes)), np.column_stack([sizes - tails, tails]).ravel())[: len(anchor)]
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    begins = (ends - sizes)[sizes > 0]
    edge[begins[begins < len(anchor)]] = True
    first = np.flatnonzero(edge)
    run = np.diff(np.append(first, len(anchor)))
    first, run = first[inside[first]], run[inside[first]]
    parts = -(-run // MOST_WINDOWS)  # of long runs
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    place = np.repeat(first, parts) + MOST_WINDOWS * number
    windows = np.minimum(np.repeat(run, parts) - MOST_WINDOWS * number, MOST_WINDOWS)
    window_anchor, anchor = anchor, anchor[place]
    spans = windows + pieces - 1
    if not len(place):
        return place, windows, anchor, np.zeros(0, bool)
    # places of anchors: a hash that is the least of a window over it equals the greatest anchor of the windows over it
    outside = np.zeros(pieces - 1, np.uint64)
    at = np.flatnonzero(hashes == anchors(np.concatenate([outside, window_anchor, outside]), pieces, np.maximum))
    low = np.searchsorted(at, place)
    n = np.searchsorted(at, place + spans) - low  # one at least: the stretch's own
    before = np.cumsum(n) - n
    near = at[np.repeat(low - before, n) + np.arange(n.sum())]
    held = np.add.reduceat(hashes[near] == np.repeat(anchor, n), before, dtype=np.int64)
    return place, windows, anchor, held > 1


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most so many bytes (a longer one alone): first row, last row + 1, joined bytes, sizes."""
    values = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        a = b


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(at, tie, data): the order of documents and their bytes. ``tie`` is 0 as long as each row has an id of its own."""
    ids = docs.select(F.col(id).cast("long").alias("id"))
    plain = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty()
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    # the lowest bit tells a missing id from the greatest one
    tie = F.lit(0).cast("long") if plain else F.xxhash64(data).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id).isNull().cast("long"))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("at"), tie.alias("tie"), data.alias("data"))


def hot_anchors(rows: DataFrame, least: int, share: int, count: int) -> np.ndarray:
    """Anchors that very many stretches have; at most ``MOST_HOT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, sizes in blocks(batch, "data"):
                anchor, n = np.unique(cut(data, sizes, least)[2].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    part = rows.where(F.pmod(F.xxhash64("at", "tie"), F.lit(share)) == 0).select("data")
    found = part.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= count)
    return np.array(sorted(r.anchor for r in found.orderBy(F.desc("n")).limit(MOST_HOT).select("anchor").collect()), np.int64)


STRETCH = "route long, anchor long, digest long, at long, tie long, place int, windows short, state byte"
PLACES = "at long, tie long, place int, windows short, state byte, anchor long"


def arrow(columns: dict[str, np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "byte": pa.int8(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n]).cast(kinds[k]) for n, k in names], [n for n, _ in names])


def stretches(rows: DataFrame, least: int, hot: np.ndarray) -> DataFrame:
    """All stretches; ``state`` COPY: equal to an earlier one of the same block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, ties = (batch.column(c).to_numpy() for c in ("at", "tie"))
            for a, b, data, sizes in blocks(batch, "data"):
                place, windows, anchor, inner = cut(data, sizes, least)
                if not len(place):
                    continue
                raw = data.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(raw[p:e]) for p, e in zip(place.tolist(), (place + windows + least - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                row = np.searchsorted(np.cumsum(sizes), place, "right")
                at, tie, anchor = ats[a:b][row], ties[a:b][row], anchor.view(np.int64)
                begins = (np.cumsum(sizes) - sizes)[row]
                order = np.lexsort((place, tie, at, digest, anchor))
                x, y, z, t = anchor[order], digest[order], at[order], tie[order]
                new = np.ones(len(order), bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                twin = np.zeros(len(order), bool)  # a repeated row: no earlier occurrence, and no other one
                twin[1:] = ~new[1:] & (z[1:] == z[head[1:]]) & (t[1:] == t[head[1:]]) & ((place - begins)[order][1:] == (place - begins)[order][head[1:]])
                state = np.where(new, np.where(inner[order], INNER, FIRST), COPY)
                if len(hot):
                    where = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
                    state[new & (hot[where] == x)] = HOT
                route = np.where(state == HOT, mixed(x.view(np.uint64) ^ ((y.view(np.uint64) >> np.uint64(3)) % np.uint64(HOT_PARTS) + np.uint64(1))).view(np.int64), x)
                copy = state == COPY
                route[copy] = mixed((z[copy] + (place[order][copy] << 20)).view(np.uint64)).view(np.int64)
                values = {"route": route, "anchor": np.where(copy, 0, x), "digest": np.where(copy, 0, y), "at": z, "tie": t, "place": (place - begins)[order], "windows": windows[order], "state": state}
                yield arrow({k: v[~twin] for k, v in values.items()}, STRETCH)

    return rows.mapInArrow(run, STRETCH)


def sift(found: DataFrame) -> DataFrame:
    """Stretches that matter: COPY (all windows repeated), FIRST, INNER or HOT (to be compared with others of the anchor or itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STRETCH.split(", ")][1:]
        held = None  # the last stretch of the anchor's last content, and whether the anchor has several
        for batch in batches:
            x = {n: batch.column(n).to_numpy().astype(np.int64) for n in names}
            passed = x["state"] == COPY
            yield arrow({k: v[passed] for k, v in x.items()}, PLACES)
            x = {k: v[~passed] for k, v in x.items()}
            told, several = False, False
            if held is not None:
                x = {k: np.append(held[0][k], v) for k, v in x.items()}
                told, several = held[1], held[2]
            n = len(x["anchor"])
            if not n:
                continue
            new_anchor, new = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = x["anchor"][1:] != x["anchor"][:-1]
            new[1:] = new_anchor[1:] | (x["digest"][1:] != x["digest"][:-1])
            group = np.cumsum(new_anchor) - 1
            contents = np.bincount(group, new)
            if several:
                contents[0] += 1
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            same = (x["at"] == x["at"][head]) & (x["tie"] == x["tie"][head]) & (x["place"] == x["place"][head])
            wanted = new & ((contents[group] > 1) | (x["state"] != FIRST))
            last_wanted, last_head = bool(wanted[head[-1]]), head[-1]
            if told:
                wanted[0] = False
            state = np.where(new, x["state"], COPY)
            yield arrow({k: v[wanted | (~new & ~same)] for k, v in (x | {"state": state}).items()}, PLACES)
            held = ({k: v[last_head : last_head + 1] for k, v in x.items()}, last_wanted or (told and last_head == 0), bool(contents[-1] > 1))
        if held is None:
            return

    dealt = found.repartition("route").sortWithinPartitions("anchor", "digest", "at", "tie", "place")
    return dealt.mapInArrow(run, PLACES)


PIECES = "route long, at long, tie long, place int, piece binary"


def told_apart(columns: dict[str, np.ndarray], piece: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Of equal ``windows`` the first stands for all: others lose their bytes, which marks them as repeated, and go to tasks
    of their own, so a window that very many texts have is one row for each block of texts. True: another row of the same
    document, to be dropped."""
    dropped = np.zeros(len(piece), bool)
    if not len(windows):
        return dropped
    route, at, tie, place = (columns[k] for k in ("route", "at", "tie", "place"))
    order = windows[np.lexsort(tuple(x[windows] for x in (place, tie, at, route)))]
    new = np.append(True, route[order][1:] != route[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    for k, h in zip(order[~new].tolist(), head[~new].tolist(), strict=True):
        if piece[k] == piece[h]:
            if (at[k], tie[k], place[k]) == (at[h], tie[h], place[h]):
                dropped[k] = True
            else:
                piece[k] = b""
                route[k] = mixed(np.array([at[k] + (int(place[k]) << 20)], np.int64).view(np.uint64)).view(np.int64)[0]
    return dropped


def pieces(texts: DataFrame, least: int) -> DataFrame:
    """Bytes of the stretches to be compared, under their anchor; of HOT ones each window, under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (place, windows, state, anchor) = parts_of(batch, "place", "windows", "state", "anchor")
            ats, ties = (batch.column(c).to_numpy() for c in ("at", "tie"))
            for a, b, data, sizes in blocks(batch, "data"):
                raw, begins = data.tobytes(), np.cumsum(sizes) - sizes
                part = np.arange(bounds[a], bounds[b])
                part = part[state[part] != COPY]
                each = np.where(state[part] == HOT, windows[part], 1)
                own = np.repeat(part, each)  # a row for each piece
                offset = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
                row = np.searchsorted(bounds, own, "right") - 1
                hot = state[own] == HOT
                start = place[own] + offset
                size = np.where(hot, 1, windows[own]) + least - 1
                for x in range(0, len(own), 1 << 15):
                    some = slice(x, x + (1 << 15))
                    first = (begins[row[some] - a] + start[some]).tolist()
                    cut_ = [raw[p : p + n] for p, n in zip(first, size[some].tolist(), strict=True)]
                    route = anchor[own[some]].copy()
                    if hot[some].any():
                        route[hot[some]] = np.array([xxhash.xxh3_64_intdigest(c) for c, h in zip(cut_, hot[some].tolist(), strict=True) if h], np.uint64).view(np.int64)
                    columns = {"route": route, "at": ats[row[some]], "tie": ties[row[some]], "place": start[some]}
                    dropped = told_apart(columns, cut_, np.flatnonzero(hot[some]))
                    if dropped.any():
                        columns = {k: v[~dropped] for k, v in columns.items()}
                        cut_ = [c for c, gone in zip(cut_, dropped.tolist(), strict=True) if not gone]
                    yield arrow(columns | {"piece": cut_}, PIECES)

    return texts.mapInArrow(run, PIECES)


RUNS = "at long, tie long, place int, windows short"


def runs_of(marked: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marks within each string: (string, first mark, marks)."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(starts, first, "right") - 1
    return owner, first - starts[owner], last - first


def codes_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash for the ``size`` bytes from each of some positions."""
    held = np.zeros((len(at), -(-size // 8) * 8), np.uint8)
    held[:, :size] = data[at[:, None] + np.arange(size)]
    code = np.zeros(len(at), np.uint64)
    for word in held.view(np.uint64).T:
        code = mixed(code * np.uint64(31) ^ word)
    return code


def may_share(route: np.ndarray, data: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Whether a piece may share a window with another of its anchor, or have one twice: False means it does not.

    Around the anchor a window has ``least`` less the anchor's bytes, and so half of them on the left or half on the
    right. Equal windows agree in that half: only pieces where one of the two codes is there twice are to be compared.
    Pieces without the anchor are single windows under their own hash, and equal in all if in anything.
    """
    size = piece_size(least)
    ends = np.cumsum(sizes)
    begins, owner = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
    if len(data) < size:
        return np.ones(len(sizes), bool)
    at = np.flatnonzero(piece_hashes(data, size) == route.view(np.uint64)[owner[: len(data) - size + 1]])
    at = at[at + size <= ends[owner[at]]]
    left = (least - size + 1) // 2
    right = least - size - left + 1
    codes, owners = [], []
    for kind, first, length in ((1, at - left, size + left), (2, at, size + right)):
        fits = (first >= begins[owner[at]]) & (first + length <= ends[owner[at]])
        own = owner[at[fits]]
        for a in range(0, len(own), CHUNK):
            some = own[a : a + CHUNK]
            codes.append(mixed(codes_at(data, first[fits][a : a + CHUNK], length) ^ mixed(route[some].view(np.uint64) + np.uint64(kind))))
        owners.append(own)
    without = np.ones(len(sizes), bool)
    without[owner[at]] = False
    owners.append(np.flatnonzero(without))
    codes.append(mixed(route[without].view(np.uint64)))
    _, code, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    shared = np.zeros(len(sizes), bool)
    shared[np.concatenate(owners)[count[code] > 1]] = True
    return shared


def candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    """Rows of pieces in their order, without those that cannot share a window; whole anchors are seen at once."""
    held: list[pa.RecordBatch] = []
    size = 0

    def told(rows: pa.Table) -> Iterator[tuple]:
        # one chunk, whatever its size: an anchor's pieces stay together
        at = rows.schema.get_field_index("piece")
        for batch in rows.set_column(at, "piece", rows.column(at).cast(pa.large_binary())).combine_chunks().to_batches():
            route, values = batch.column("route").to_numpy(), batch.column("piece")
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] else np.zeros(0, np.uint8)
            sizes = np.diff(offsets)
            wanted = batch.filter(pa.array((sizes == 0) | may_share(route, data, sizes, least)))
            yield from zip(*(c.to_pylist() for c in wanted.columns), strict=True)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        last = batch.column("route")[-1].as_py() if len(batch) else None
        if size < SEEN_BYTES or last is None or held[0].column("route")[0].as_py() == last:
            continue
        rows = pa.Table.from_batches(held)
        end = int(np.searchsorted(rows.column("route").to_numpy(), last))
        yield from told(rows.slice(0, end))
        held = rows.slice(end).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield from told(pa.Table.from_batches(held))


def compare(found: DataFrame, least: int) -> DataFrame:
    """Runs of windows that an earlier piece has too, by an index of whole anchors of up to ``INDEX_BYTES``."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1:4])
        rows = [r for k, r in enumerate(rows) if not k or r[1:4] != rows[k - 1][1:4]]  # rows that are one document
        index = RunIndex([r[4] for r in rows])
        owner, first, n = runs_of(index.repeated(least), index.starts)
        at, tie, place = (np.array([r[k] for r in rows], np.int64)[owner] for k in (1, 2, 3))
        return arrow({"at": at, "tie": tie, "place": place + first, "windows": n}, RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # of finished anchors
        part: list[tuple] = []  # of the present one
        known: list[tuple] = []  # windows whose repetition is plain
        size = part_size = 0
        rows = candidates(batches, least)
        while some := list(islice(rows, MOST_ROWS)):
            for row in some:
                if not row[4]:
                    known.append(row)
                    continue
                if part and row[0] != part[0][0]:
                    if size and size + part_size > INDEX_BYTES:
                        yield marks(whole)
                        whole, size = [], 0
                    whole, size = whole + part if size else part, size + part_size
                    part, part_size = [], 0
                if part and row[4] == part[-1][4] and len(row[4]) == least:  # the order is by content, then place
                    if row[1:4] != part[-1][1:4]:
                        known.append(row)
                    continue
                part.append(row)
                part_size += len(row[4]) + 1
            if known:
                yield arrow({"at": [r[1] for r in known], "tie": [r[2] for r in known], "place": [r[3] for r in known], "windows": [1] * len(known)}, RUNS)
                known = []
        for rows in (whole + part,) if size + part_size <= INDEX_BYTES else (whole, part):
            if rows:
                yield marks(rows)

    dealt = found.repartition("route").sortWithinPartitions("route", "piece", "at", "tie", "place")
    return dealt.mapInArrow(run, RUNS)


RESULT = "at long, tie long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"


def parts_of(batch: pa.RecordBatch, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the parts of each row begin, and the fields of all of them."""
    lists = batch.column("parts")
    flat = lists.flatten()
    bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    return bounds, [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def cut_out(texts: DataFrame, least: int) -> DataFrame:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def spans(place: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(place)
        first, last = place[order], np.maximum.accumulate(end[order])
        apart = np.ones(len(first), bool)
        apart[1:] = first[1:] > last[:-1]
        return first[apart].tolist(), last[np.append(np.flatnonzero(apart)[1:], len(first)) - 1].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (place, windows) = parts_of(batch, "place", "windows")
            end = place + windows + least - 1
            for a, b, data, sizes in blocks(batch, "data"):
                raw, at = data.tobytes(), 0
                removed, found, kept = [], [], []
                for k, size in enumerate(sizes.tolist(), a):
                    i, j = bounds[k], bounds[k + 1]
                    begins, ends = spans(place[i:j], end[i:j]) if j > i else ([], [])
                    kept.append(b"".join(raw[at + x : at + y] for x, y in zip([0, *ends], [*begins, size], strict=True)))
                    removed.append(size - len(kept[-1]))
                    found.append([{"start": x, "length": y - x} for x, y in zip(begins, ends, strict=True)])
                    at += size
                rows = [batch.column(c).slice(a, b - a) for c in ("at", "tie")]
                values = [*rows, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(found, spans_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["at", "tie", "n_bytes", "n_removed", "spans", "kept"])

    return texts.mapInArrow(run, RESULT)


def copied(rows: DataFrame, least: int) -> DataFrame:
    """(at, tie, size) of documents whose whole text, of ``least`` bytes or more, an earlier document has."""
    size = F.octet_length("data").cast("long")
    known = materialize(rows.where(size >= least).select("at", "tie", size.alias("size"), F.unhex(F.sha2("data", 256)).alias("digest")), "digests")
    first = known.groupBy("digest").agg(F.min(F.struct("at", "tie")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = known.join(first, "digest").where(F.struct("at", "tie") != F.col("first"))
    return materialize(later.select("at", "tie", "size").distinct(), "copies")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, hot_share: int = HOT_SHARE, hot_count: int = HOT_COUNT) -> DataFrame:
    """id, n_bytes, n_removed, ``spans`` (maximal removed runs, in bytes) and ``kept`` (the other bytes, joined) of each row."""
    key = ["at", "tie"]
    rows = keyed(docs, id, text)
    again = copied(rows, least)
    texts = rows.join(again.select(*key), key, "left_anti")
    hot = hot_anchors(texts, least, hot_share, hot_count)
    part = F.struct("place", "windows", "state", "anchor")
    sifted = materialize(sift(stretches(texts, least, hot)).groupBy(*key).agg(F.collect_list(part).alias("parts")), "stretches")
    unfinished = sifted.where(F.exists("parts", lambda p: p["state"] != COPY))
    found = compare(pieces(texts.join(unfinished, key), least), least)
    count = F.col("size") - least + 1
    whole_texts = again.select(*key, count.alias("count"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(MOST_RUN).cast("long"))).alias("at_"))
    whole_texts = whole_texts.select(*key, F.col("at_").cast("int").alias("place"), F.least(F.col("count") - F.col("at_"), F.lit(MOST_RUN)).cast("short").alias("windows"))
    copies = sifted.select(*key, F.explode(F.filter("parts", lambda p: p["state"] == COPY)).alias("p")).select(*key, "p.place", "p.windows")
    runs = copies.unionByName(found).unionByName(whole_texts).groupBy(*key).agg(F.collect_list(F.struct("place", "windows")).alias("parts"))
    whole = rows.join(runs, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<place:int,windows:short>>")))
    named = F.when((F.col("at") == NO_ID) & (F.col("tie").bitwiseAND(1) == 1), None).otherwise(F.col("at"))
    return cut_out(whole, least).select(named.alias(id), "n_bytes", "n_removed", "spans", "kept")
