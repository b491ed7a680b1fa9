"""Structure repair of conversations: the cheapest edits that make roles alternate, by a time-major tensor programme.

Faults of single turns are found with built-in functions. The turns of a conversation then meet, in order, in one task,
as small codes (initial of the role, fault). Conversations are cut into blocks of at most ``BLOCK`` turns and blocks of
like length (by powers of two) lie side by side in one tensor, turn by turn. Costs of the four states (nothing yet, after
system, after user, after assistant) are updated backward for all blocks at once and kept; a second sweep traces the
edits of all blocks forward. Blocks of a longer conversation are first reckoned for each state they may end in, composed
from last to first, then traced from each state they may begin in.

Edits: keep a turn (cost 0), give it the role user or assistant (2), delete it (3; blank turns and repetitions must go),
insert an empty turn of user or assistant (2); a truncated turn that stays costs 1 more. The role initials that result
read ``(s?(ua)+)?``. Of the cheapest edits those whose letters (D, I, K, R) come first in ASCII are taken.

Defined results: null roles and texts are one space; turns are ordered by turn, nulls first, then by role and text; a null
conversation id is a conversation of its own; a role without an initial is no legal one; a conversation without turns has
zeros, an empty audit and nothing repaired; an empty table gives an empty result; further columns are ignored. A digest
of a conversation reads its turns in order, so one task has them all, but not in memory: beyond ``HELD_BYTES`` its texts
wait in a scratch file of the task, and only a few bytes for each turn stay.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK, HELD_BYTES = 512, 32 << 20
BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = 0, 1, 2, 3, 9
#: States and role initials: nothing or another one, system, user, assistant. ``PAD``: no turn.
S, U, A, PAD = 1, 2, 3, 4
GIVEN = np.array([U, U, A, U])  # the state after an inserted turn, or one with a new role
KEPT = np.full((4, 5), -1)  # the state after a kept turn, by state and initial
KEPT[0, S], KEPT[0, U], KEPT[S, U], KEPT[U, A], KEPT[A, U] = S, U, U, A, U
FINAL = np.array([0, 4, 2, 0])
NEVER = 1 << 40
DELETE, KEEP, REROLE = 0, 1, 2
LETTER = np.frombuffer(b"DKR", np.uint8)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by a hash of id and turn; turns that it drops stay as rows with ``gone``."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(place, "utf-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def with_codes(turns: DataFrame) -> DataFrame:
    """Turns in order within their tasks, with ``initial`` and ``fault`` codes. ``gone`` (optional): no turn, but its conversation is there."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    bare = F.ltrim(end, F.lit(BLANKS)) == ""
    fault = F.when(F.col("gone"), GONE).when(bare, BLANK).when(again, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(0)
    coded = rows.select("conv_id", "turn", "role", "text", initial.cast("byte").alias("initial"), fault.cast("byte").alias("fault"), again.alias("again"))
    return coded.sortWithinPartitions("conv_id", "turn", "role", "text", "again").drop("again")


def backward(initial: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [turn, block, state] from before each turn on, by the costs ``end`` [block, state] after the last."""
    turns, blocks = initial.shape
    cost = np.empty((turns + 1, blocks, 4), np.int64)
    cost[turns] = end
    column = np.arange(blocks)[:, None]
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        to = KEPT[:, initial[t]].T
        may = ((fault[t] == FINE) | (fault[t] == TRUNCATED))[:, None]
        more = (fault[t] == TRUNCATED)[:, None]
        kept = np.where(may & (to >= 0), after[column, to] + more, NEVER)
        given = np.where(may, after[:, GIVEN] + 2 + more, NEVER)
        now = np.minimum(np.minimum(after + 3, kept), given)
        for _ in range(2):
            now = np.minimum(now, now[:, GIVEN] + 2)
        cost[t] = np.where((initial[t] == PAD)[:, None], after, now)
    return cost


def forward(initial: np.ndarray, fault: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edits of each turn [turn, block], how many turns are inserted before it, the states after those, and the last states."""
    turns, blocks = initial.shape
    edit, inserted, entered = (np.zeros((turns, blocks), np.int8) for _ in range(3))
    state, each = state.copy(), np.arange(blocks)
    for t in range(turns):
        real = initial[t] != PAD
        for _ in range(2):
            now, gone = cost[t, each, state], cost[t + 1, each, state] + 3
            insert = real & (now != gone) & (now == cost[t, each, GIVEN[state]] + 2)
            inserted[t] += insert
            state = np.where(insert, GIVEN[state], state)
        now, gone = cost[t, each, state], cost[t + 1, each, state] + 3
        entered[t] = state
        to = KEPT[state, initial[t]]
        may = (fault[t] == FINE) | (fault[t] == TRUNCATED)
        kept = may & (to >= 0) & (now == cost[t + 1, each, to] + (fault[t] == TRUNCATED))
        edit[t] = np.where(now == gone, DELETE, np.where(kept, KEEP, REROLE))
        state = np.where(real & (edit[t] == KEEP), to, np.where(real & (edit[t] == REROLE), GIVEN[state], state))
    return edit, inserted, entered, state


def solve(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cost, last state) of each conversation, (edit, inserted, entered) of each turn. ``starts``: where conversations begin."""
    sizes = np.diff(np.append(starts, len(initial)))
    parts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[owner] + number * BLOCK
    length = np.minimum(sizes[owner] - number * BLOCK, BLOCK)
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    many = parts[owner] > 1

    def tensors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        most = length[blocks].max()
        step = np.arange(most)[:, None]
        there = step < length[blocks]
        at = np.where(there, begin[blocks] + step, 0)
        return np.where(there, initial[at], PAD), np.where(there, fault[at], FINE), there, at

    def buckets(of: np.ndarray) -> Iterator[np.ndarray]:
        for size in np.unique(bucket[of]):
            yield of[bucket[of] == size]

    through = np.zeros((len(owner), 4, 4), np.int64)  # cost of a block by its first and last states
    for blocks in buckets(np.flatnonzero(many)):
        first, wrong, _, _ = tensors(blocks)
        for last in range(4):
            end = np.full((len(blocks), 4), NEVER)
            end[:, last] = 0
            through[blocks, :, last] = np.minimum(backward(first, wrong, end)[0], NEVER)
    after = np.tile(FINAL, (len(owner), 1)).astype(np.int64)  # costs from the end of each block on
    for k in range(int(parts.max(initial=0)) - 2, -1, -1):
        blocks = np.flatnonzero(many & (number == k) & (number < parts[owner] - 1))
        after[blocks] = np.minimum((through[blocks + 1] + after[blocks + 1][:, None, :]).min(axis=2), NEVER)

    cost, last_state = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    edit, inserted, entered = (np.zeros(len(initial), np.int8) for _ in range(3))
    ways, leaves = {}, np.zeros((len(owner), 4), np.int64)
    for blocks in buckets(np.arange(len(owner))):
        first, wrong, there, at = tensors(blocks)
        costs = backward(first, wrong, after[blocks])
        head = number[blocks] == 0
        cost[owner[blocks[head]]] = costs[0, head, 0]
        alone = not many[blocks].any()
        for state in range(1 if alone else 4):
            *way, leaves[blocks, state] = forward(first, wrong, costs, np.full(len(blocks), state))
            ways[blocks[0], state] = (blocks, there, at, way)
    came = np.zeros(len(owner), np.int64)  # the state in which each block is entered
    for k in range(1, int(parts.max(initial=0))):
        blocks = np.flatnonzero(number == k)
        came[blocks] = leaves[blocks - 1, came[blocks - 1]]
    for (_, state), (blocks, there, at, way) in ways.items():
        taken = there & (came[blocks] == state)
        for out, values in zip((edit, inserted, entered), way, strict=True):
            out[at[taken]] = values[taken]
    tail = number == parts[owner] - 1
    last_state[owner[tail]] = leaves[np.flatnonzero(tail), came[tail]]
    return cost, last_state, edit, inserted, entered


def audits(edit: np.ndarray, inserted: np.ndarray, starts: np.ndarray, last_state: np.ndarray) -> list[str]:
    """Letters of all edits of each conversation."""
    letters = np.zeros((len(edit), 3), np.uint8)
    letters[:, 0][inserted > 0] = letters[:, 1][inserted > 1] = ord("I")
    letters[:, 2] = LETTER[edit]
    ends = np.cumsum((letters != 0).sum(axis=1))
    flat = letters.reshape(-1)
    flat = flat[flat != 0].tobytes().decode("ascii")
    last = np.append(starts[1:], len(edit))
    bound = np.append(0, ends)
    return [flat[bound[a] : bound[b]] + "I" * (FINAL[s] // 2) for a, b, s in zip(starts.tolist(), last.tolist(), last_state.tolist(), strict=True)]


def repaired(role: list[str], text: list[str], edit: np.ndarray, inserted: np.ndarray, entered: np.ndarray) -> Iterator[tuple[int, str, str]]:
    """(turn's row or -1, role, text) of the repaired turns."""
    for k, (e, n, s) in enumerate(zip(edit.tolist(), inserted.tolist(), entered.tolist(), strict=True)):
        if n:
            if n == 2:
                yield -1, "user", ""
            yield -1, "assistant" if s == A else "user", ""
        if e == KEEP:
            yield k, role[k], text[k]
        elif e == REROLE:
            yield k, "assistant" if s == U else "user", text[k]


def ending(last_state: int) -> list[tuple[int, str, str]]:
    return [(-1, r, "") for r in {S: ["user", "assistant"], U: ["assistant"]}.get(last_state, [])]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def counted(turn: np.ndarray, known: np.ndarray, initial: np.ndarray, fault: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Gaps, faults and illegal neighbours of conversations of one turn at least."""
    out = {name: np.add.reduceat((fault == code).astype(np.int64), starts) for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    inner = np.ones(len(turn), bool)
    inner[starts] = False
    legal = np.zeros((4, 4), bool)
    legal[S, U] = legal[U, A] = legal[A, U] = True
    wrong = np.zeros(len(turn), np.int64)
    wrong[1:] = inner[1:] & ~legal[initial[:-1], initial[1:]]
    out["illegal"] = np.add.reduceat(wrong, starts)
    fresh = known.copy()
    fresh[1:] &= ~(inner[1:] & known[:-1] & (turn[1:] == turn[:-1]))
    distinct = np.add.reduceat(fresh.astype(np.int64), starts)
    # null turns come first; a conversation's last turn is its largest, the first known one its least
    last = turn[np.append(starts[1:], len(turn)) - 1]
    least = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), starts)
    out["gaps"] = np.where(distinct > 0, last - least + 1 - distinct, 0)
    return out


class Scratch:
    """Turns of a long conversation: codes in memory, texts in a file of the task."""

    def __init__(self, first: pa.Table):
        self.id, self.codes = first.column("conv_id").slice(0, 1), []
        self.file = tempfile.TemporaryFile()
        self.writer = pa.ipc.new_stream(self.file, first.select(["role", "text", "fault"]).schema)

    def add(self, rows: pa.Table) -> None:
        self.codes.append(rows.select(["turn", "initial", "fault"]))
        self.writer.write_table(rows.select(["role", "text", "fault"]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.writer.close()
        self.file.seek(0)
        yield from pa.ipc.open_stream(self.file)
        self.file.close()


def _codes(rows: pa.Table) -> tuple[np.ndarray, ...]:
    turn = rows.column("turn")
    known = turn.is_valid().to_numpy()
    return turn.fill_null(0).to_numpy(), known, rows.column("initial").to_numpy(), rows.column("fault").to_numpy()


def _boundaries(rows: pa.Table) -> np.ndarray:
    """Where conversations begin."""
    code = rows.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode")
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def repair(turns: DataFrame, as_turns: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), or
    ``as_turns`` one for each repaired turn (conv_id, place, role, text, turn; null turn: inserted)."""
    coded = with_codes(turns)
    schema = StructType([coded.schema["conv_id"]])
    if as_turns:
        schema = schema.add("place", "long").add("role", "string").add("text", "string").add("turn", "long")
    else:
        for name in COUNTS:
            schema = schema.add(name, "long")
        schema = schema.add("audit", "string").add("repaired_sha256", "string")

    def answer(ids: pa.Array, columns: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] if as_turns else [pa.int64()] * len(COUNTS) + [pa.string()] * 2
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.fieldNames())

    def told(ids: pa.Array, n: int, filled: np.ndarray, counts: dict, audit: list[str], digest: list[str]) -> pa.RecordBatch:
        """Of n conversations; those of ``filled`` have turns."""
        columns = []
        for name in COUNTS:
            values = np.zeros(n, np.int64)
            values[filled] = counts[name]
            columns.append(values)
        texts = [[""] * n, [hashlib.sha256().hexdigest()] * n]
        for k, a, d in zip(filled.tolist(), audit, digest, strict=True):
            texts[0][k], texts[1][k] = a, d
        return answer(ids, columns + texts)

    def several(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole conversations."""
        begins = _boundaries(rows)
        turn, known, initial, fault = _codes(rows)
        live = fault != GONE
        conversation = (np.cumsum(np.isin(np.arange(len(fault)), begins)) - 1)[live]
        filled, starts = np.unique(conversation, return_index=True)
        ids = rows.column("conv_id").take(pa.array(begins))
        if not len(filled):
            if not as_turns:
                yield told(ids, len(begins), filled, {n: 0 for n in COUNTS}, [], [])
            return
        turn, known, initial, fault = turn[live], known[live], initial[live], fault[live]
        role, text = (rows.column(c).filter(pa.array(live)).to_pylist() for c in ("role", "text"))
        cost, last_state, edit, inserted, entered = solve(initial, fault, starts)
        ends = np.append(starts[1:], len(turn))
        digests, owners, rest = [], [], []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            out = [*repaired(role[a:b], text[a:b], edit[a:b], inserted[a:b], entered[a:b]), *ending(int(last_state[k]))]
            if as_turns:
                owners += [int(filled[k])] * len(out)
                rest += [(p, r, t, int(turn[a + at]) if at >= 0 and known[a + at] else None) for p, (at, r, t) in enumerate(out)]
            else:
                digests.append(hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode("utf-8", "surrogatepass")).hexdigest())
        if as_turns:
            yield answer(ids.take(pa.array(owners, pa.int64())), list(zip(*rest, strict=True)) or [[]] * 4)
        else:
            yield told(ids, len(begins), filled, counted(turn, known, initial, fault, starts) | {"cost": cost}, audits(edit, inserted, starts, last_state), digests)

    def long(scratch: Scratch) -> Iterator[pa.RecordBatch]:
        turn, known, initial, fault = _codes(pa.concat_tables(scratch.codes))
        live = fault != GONE
        turn, known, initial, fault = turn[live], known[live], initial[live], fault[live]
        start = np.zeros(min(1, len(turn)), np.int64)
        cost, last_state, edit, inserted, entered = solve(initial, fault, start)
        digest, place, at = hashlib.sha256(), 0, 0
        for batch in [*([b] for b in scratch.rows()), []]:
            if batch:
                there = pa.array(batch[0].column("fault").to_numpy() != GONE)
                role, text = (batch[0].column(c).filter(there).to_pylist() for c in ("role", "text"))
                part = slice(at, at + len(role))
                out = list(repaired(role, text, edit[part], inserted[part], entered[part]))
            else:
                part, out = slice(at, at), ending(int(last_state[0])) if len(start) else []
            if as_turns and out:
                rows = [(place + p, r, t, int(turn[at + k]) if k >= 0 and known[at + k] else None) for p, (k, r, t) in enumerate(out)]
                yield answer(pa.concat_arrays([scratch.id.combine_chunks()] * len(rows)), list(zip(*rows, strict=True)))
            for p, (_, r, t) in enumerate(out):
                digest.update(("\n" * bool(place + p) + f"{r}:{t}").encode("utf-8", "surrogatepass"))
            place, at = place + len(out), part.stop
        if not as_turns:
            counts = counted(turn, known, initial, fault, start) | {"cost": cost} if len(start) else {n: 0 for n in COUNTS}
            yield told(scratch.id, 1, start, counts, audits(edit, inserted, start, last_state), [digest.hexdigest()] * len(start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        scratch: Scratch | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            if scratch is not None:
                own = _boundaries(pa.concat_tables([pa.table({"conv_id": scratch.id}), rows.select(["conv_id"])]))
                size = int(own[1]) - 1 if len(own) > 1 else rows.num_rows
                scratch.add(rows.slice(0, size))
                rows = rows.slice(size)
                if not rows.num_rows:
                    continue
                yield from long(scratch)
                scratch = None
            held = pa.concat_tables([held, rows]) if held is not None else rows
            last = int(_boundaries(held)[-1])
            if last:
                yield from several(held.slice(0, last))
                held = held.slice(last).combine_chunks()
            if held.nbytes > held_bytes:
                scratch = Scratch(held)
                scratch.add(held)
                held = None
        if scratch is not None:
            yield from long(scratch)
        if held is not None:
            yield from several(held)

    return coded.mapInArrow(run, schema)
