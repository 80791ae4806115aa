"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``.

A conversation's rows are taken by turn (nulls first; rows of one turn in the order of a hash of role and text, equal rows
together). Every row may be kept (K, free), given the role that fits (R), or deleted (D, demanded of blank rows and of
those whose role and text came earlier); empty turns may be inserted anywhere (I); a truncated row that stays costs extra.
Of all cheapest edits those whose initials are least in ASCII order are taken.

How it runs: rows shrink to one byte each (role, faults) and are range-partitioned by conversation and turn, so that a
conversation of any length spreads over tasks. Each task cuts its sorted stream into pieces of ``PIECE`` rows at most, as
a rule whole conversations. Pieces are bucketed by length and laid time-major into NumPy tensors; one step a turn updates
the costs-to-go of all pieces and all grammar states, the costs are stored, and the edits are traced forward in the same
way. A conversation of several pieces has each piece's costs between all pairs of states worked out first (a 4 x 4 matrix);
these are chained backward along the conversation, then the states forward, and each piece is traced from its true state.
The repaired text is streamed past one hasher a conversation; texts are shuffled once and never gathered.

Defined cases: null roles and texts are taken as one space (both at fault: no legal role, and blank); an empty role has no
legal initial and can't be kept; null conversation ids form one conversation; conversations without rows have no edits, an
empty audit and the hash of an empty text; very long texts are hashed as they come; an empty table gives an empty result.
Turns have to be integers (TypeError otherwise), ids of any type that can be grouped and sorted. Columns besides the four
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import integer_id, materialize

RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
#: Rows of a piece at most, and cells of a tensor (rows times pieces) at most.
PIECE, CELLS = 1 << 14, 1 << 17
WHITE = " \t\n\v\f\r"

# A row's byte: its role's initial in the low bits, then faults, and a mark for tensor places beyond a piece's end.
SYSTEM, USER, ASSISTANT = 1, 2, 3
FORCED, CUT, PAD = 4, 8, 16
#: Grammar states are what was written last: nothing, s, u, a. The turn that comes next unless it is s, and what it leads to.
WANTED = np.array([USER, USER, ASSISTANT, USER])
START, FAR = 0, np.int64(1) << 40


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows harmed by crc32 of ``conv_id:turn`` modulo 20, n the times a row stands there.

    0 drops the row (n is 0), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(harm == 4, "user").otherwise(said("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("long").alias("n"))


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]


def faults(rows: DataFrame) -> DataFrame:
    """One row for each different row of a conversation: (conv_id, turn, h1, h2, n, initial, blank, cut, again).

    ``again`` tells that role and text came in an earlier turn; of n equal rows all but the first are duplicates besides.
    """
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(0)
    slim = rows.select("conv_id", "turn", "n", *_hashes(), initial.cast("int").alias("initial"), (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("cut"))
    slim = slim.groupBy("conv_id", "turn", "h1", "h2").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("initial", "blank", "cut")])
    spot = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = slim.where("n > 0").groupBy("conv_id", "h1", "h2").agg(F.min(spot).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("h1").alias("f_h1"), F.col("h2").alias("f_h2"), "first")
    both = slim.join(firsts, slim["conv_id"].eqNullSafe(firsts["f_conv"]) & (slim["h1"] == firsts["f_h1"]) & (slim["h2"] == firsts["f_h2"]), "left")
    return both.select(*slim.columns, (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.at"))).alias("again"))


def _counts(rows: DataFrame) -> DataFrame:
    """Per conversation, those without rows too: gaps between turns and each row's first fault."""
    there, n = F.col("n") > 0, F.col("n")
    turn = F.when(there, F.col("turn"))
    first = there & ~F.col("blank") & ~F.col("again")
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(there, n - first.cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((first & F.col("cut")).cast("long")).alias("truncated"),
    )


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, at, codes, edge): the rows of ``faults`` as bytes, cut where a conversation, a task or ``piece`` ends.

    ``edge`` tells that the conversation may go on in another piece.
    """
    first = F.col("initial").bitwiseOR(F.when(F.col("blank") | F.col("again"), FORCED).when(F.col("cut"), CUT).otherwise(0)).cast("byte")
    rest = F.col("initial").bitwiseOR(F.lit(FORCED)).cast("byte")
    keys = ["conv_id", "turn", "h1", "h2"]
    dealt = rows.where("n > 0").select(*keys, "n", first.alias("first"), rest.alias("rest")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        for at, (conv, codes, edge) in enumerate(_cut_up(_coded(batches), piece)):
            done.append((conv, part, at, codes, edge))
            if len(done) == 4096:
                yield _batch(done, kind)
                done = []
        if done:
            yield _batch(done, kind)

    return dealt.mapInArrow(run, _schema(kind, "part int, at long, codes binary, edge boolean"))


def _schema(kind: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(rest)])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, bytes]]:
    """(conversation, whether it is another than before, codes of some of its rows), each of a million bytes at most."""
    begun, last = False, None
    for batch in batches:
        ids = batch.column("conv_id")
        if not len(ids):
            continue
        before, after = ids[:-1], ids[1:]
        same = pc.or_(pc.fill_null(pc.equal(before, after), False), pc.and_(pc.is_null(before), pc.is_null(after))).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(~same) + 1).tolist(), len(ids)]
        n, one, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "first", "rest"))
        for a, b in zip(bounds, bounds[1:], strict=False):
            conv = ids[a].as_py()
            new = not begun or conv != last
            begun, last = True, conv
            for codes in _expanded(n[a:b], one[a:b].astype(np.uint8), more[a:b].astype(np.uint8)):
                yield conv, new, codes
                new = False


def _expanded(n: np.ndarray, one: np.ndarray, more: np.ndarray, most: int = 1 << 20) -> Iterator[bytes]:
    """Each row's first code, then n - 1 times its other one."""
    if n.sum() <= most:
        out = np.repeat(more, n)
        out[np.cumsum(n) - n] = one
        yield out.tobytes()
        return
    for k in range(len(n)):
        yield one[k : k + 1].tobytes()
        for left in range(int(n[k]) - 1, 0, -most):
            yield more[k : k + 1].tobytes() * min(left, most)


def _cut_up(coded: Iterator[tuple[object, bool, bytes]], piece: int) -> Iterator[tuple[object, bytes, bool]]:
    """(conversation, codes, edge) of pieces. The first and the last conversation of a task are edges, and those of several
    pieces."""
    conv, held, size, begun, several = None, [], 0, False, True
    for own, new, codes in coded:
        if new:
            if begun and held:
                yield conv, b"".join(held), several
            conv, held, size, several, begun = own, [], 0, not begun, True
        while codes:
            if size == piece:  # only now is it known that more follows
                yield conv, b"".join(held), True
                held, size, several = [], 0, True
            held.append(codes[: piece - size])
            size, codes = size + len(held[-1]), codes[piece - size :]
    if held:
        yield conv, b"".join(held), True


def _batch(rows: list[tuple], kind: T.DataType) -> pa.RecordBatch:
    types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "at", "codes", "edge"])


# ---- tensors: [turn, piece] of codes, [turn, piece, state] of costs


def tensors(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``codes``, time-major codes), bucketed by length: a bucket's pieces are padded to its longest one, which
    is at most an eighth longer than its shortest (plus 4)."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        most = sizes[order[a]] * 9 // 8 + 4
        b = a + 1
        while b < len(order) and sizes[order[b]] <= most and (b + 1 - a) * sizes[order[b]] <= CELLS:
            b += 1
        own = order[a:b]
        grid = np.full((sizes[own[-1]], b - a), PAD, np.uint8)
        for j, i in enumerate(own):
            grid[: sizes[i], j] = np.frombuffer(codes[i], np.uint8)
        yield own, grid
        a = b


def _steps(code: np.ndarray, c: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(price of staying by state, whether that means a new role, whether s may open, padding) of one turn."""
    role, forced, late = code & 3, (code & FORCED) > 0, np.where(code & CUT, c.truncated, 0).astype(np.int64)
    new = role[:, None] != WANTED
    stay = np.where(forced[:, None], FAR, late[:, None] + np.where(new, c.rerole, 0))
    opens = np.where((role == SYSTEM) & ~forced, late, FAR)
    return stay, new, opens, (code & PAD) > 0


def _with_inserts(cost: np.ndarray, c: Costs) -> np.ndarray:
    """Costs-to-go where empty turns may be written first."""
    out = cost.copy()
    out[..., 2] = np.minimum(cost[..., 2], c.insert + cost[..., 3])
    out[..., 3] = np.minimum(cost[..., 3], c.insert + cost[..., 2])
    out[..., :2] = np.minimum(cost[..., :2], c.insert + out[..., 2:3])
    return out


def closing(c: Costs) -> np.ndarray:
    """Costs-to-go at a conversation's end: nothing and a may end it."""
    return _with_inserts(np.array([0, FAR, FAR, 0], np.int64), c)


def backward(grid: np.ndarray, end: np.ndarray, c: Costs) -> np.ndarray:
    """Costs-to-go [turn + 1, piece, state], the last of them ``end`` [piece, state]."""
    to_go = np.empty((len(grid) + 1, grid.shape[1], 4), np.int64)
    to_go[-1] = end
    for t in range(len(grid) - 1, -1, -1):
        after = to_go[t + 1]
        stay, _, opens, pad = _steps(grid[t], c)
        cost = np.minimum(c.delete + after, stay + after[:, WANTED])
        cost[:, START] = np.minimum(cost[:, START], opens + after[:, SYSTEM])
        to_go[t] = np.where(pad[:, None], after, np.minimum(_with_inserts(cost, c), FAR))
    return to_go


def trace(grid: np.ndarray, to_go: np.ndarray, state: np.ndarray, c: Costs) -> tuple[list[bytes], np.ndarray]:
    """The edits' initials of each piece from its ``state`` on, least in ASCII order among the cheapest, and the states behind."""
    turns, n = grid.shape
    said = np.zeros((n, turns, 3), np.uint8)
    every, state = np.arange(n), state.copy()
    for t in range(turns):
        stay, new, opens, pad = _steps(grid[t], c)
        open_ = ~pad
        for slot in range(3):
            goal, after = to_go[t, every, state], to_go[t + 1]
            drop = open_ & (c.delete + after[every, state] == goal)
            add = open_ & ~drop & (c.insert + to_go[t, every, WANTED[state]] == goal)
            go = open_ & ~drop & ~add
            first = go & (state == START) & (opens + after[:, SYSTEM] == goal)
            keep = first | (go & ~new[every, state])
            said[:, t, slot] = np.select([drop, add, keep, go], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.where(first, SYSTEM, np.where(add | go, WANTED[state], state))
            open_ = add
    return [row.tobytes().replace(b"\0", b"") for row in said], state


def solve(codes: list[bytes], ends: np.ndarray, starts: np.ndarray, c: Costs) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(edits, state behind, cost from the start on) of each piece, given costs-to-go behind it and its first state."""
    edits, behind, cost = [b""] * len(codes), np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    for own, grid in tensors(codes):
        to_go = backward(grid, ends[own], c)
        said, behind[own] = trace(grid, to_go, starts[own], c)
        cost[own] = to_go[0, np.arange(len(own)), starts[own]]
        for i, x in zip(own, said, strict=True):
            edits[i] = x
    return edits, behind, cost


def passage(codes: list[bytes], c: Costs) -> np.ndarray:
    """[piece, from, to]: the cheapest way through each piece between any two states."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for own, grid in tensors(codes):
        for to in range(4):
            end = np.full((len(own), 4), FAR)
            end[:, to] = 0
            out[own, :, to] = backward(grid, end, c)[0]
    return out


#: What has to be written after the last row, by the state behind it.
TAIL = np.array(["", "II", "I", ""])


def _illegal(codes: bytes) -> int:
    role = np.frombuffer(codes, np.uint8) & 3
    return int(np.sum(~_legal(role[:-1], role[1:])))


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((b == USER) & ((a == SYSTEM) | (a == ASSISTANT))) | ((a == USER) & (b == ASSISTANT))


def _whole(cut: DataFrame, c: Costs) -> DataFrame:
    """Conversations of one piece."""
    kind = cut.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            edits, behind, cost = solve(codes, np.tile(closing(c), (len(codes), 1)), np.zeros(len(codes), np.int64), c)
            audit = [e.decode() + str(TAIL[s]) for e, s in zip(edits, behind, strict=True)]
            columns = [batch.column("conv_id"), pa.array([_illegal(x) for x in codes], pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "illegal", "cost", "audit"])

    return cut.select("conv_id", "codes").mapInArrow(run, _schema(kind, "illegal long, cost long, audit string"))


def _split(cut: DataFrame, c: Costs) -> DataFrame:
    """Conversations of several pieces, told apart by their first piece (head, head_at). What meets in one task is some
    thirty numbers a piece, which has ``PIECE`` rows or ends with its task's share."""
    names, places = ["head", "head_at", "part", "at"], "head int, head_at long, part int, at long"

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[names].assign(ways=[m.ravel().tolist() for m in passage([bytes(x) for x in f["codes"]], c)])

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "at"], ignore_index=True)
        ends, after = [], closing(c)
        for ways in reversed(f["ways"].tolist()):
            ends.append(after.tolist())
            after = np.minimum((np.array(ways).reshape(4, 4) + after).min(axis=1), FAR)
        return f[names].assign(end=ends[::-1])

    def from_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            codes = [bytes(x) for x in f["codes"]]
            ends = np.array(f["end"].tolist(), np.int64).reshape(-1, 4)
            runs = [solve(codes, ends, np.full(len(codes), s), c) for s in range(4)]
            yield f[names].assign(
                edits=[[r[0][i].decode() for r in runs] for i in range(len(codes))],
                behind=[[int(r[1][i]) for r in runs] for i in range(len(codes))],
                cost=[int(x) for x in runs[START][2]],
                illegal=[_illegal(x) for x in codes],
                first=[x[0] & 3 for x in codes],
                last=[x[-1] & 3 for x in codes],
            )

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "at"], ignore_index=True)
        states, state = [], START
        for behind in f["behind"]:
            states.append(state)
            state = int(behind[state])
        joints = [0, *(~_legal(f["last"].to_numpy()[:-1], f["first"].to_numpy()[1:])).tolist()]
        cost, rest = [int(f["cost"][0])] + [0] * (len(f) - 1), [""] * (len(f) - 1)
        return f[names].assign(state=states, cost=cost, illegal=f["illegal"] + np.array(joints, np.int64), tail=[*rest, str(TAIL[state])])

    key = ["part", "at"]
    ways = cut.select(*names, "codes").mapInPandas(matrices, f"{places}, ways array<bigint>")
    ends = ways.groupBy("head", "head_at").applyInPandas(chain, f"{places}, end array<bigint>")
    known = cut.select(*names, "codes").join(ends.select(*key, "end"), key).select(*names, "codes", "end")
    traced = known.mapInPandas(from_all, f"{places}, edits array<string>, behind array<bigint>, cost long, illegal long, first long, last long")
    traced = materialize(traced, "conversation-traces")
    walked = traced.drop("edits").groupBy("head", "head_at").applyInPandas(walk, f"{places}, state int, cost long, illegal long, tail string")
    chosen = traced.select(*key, "edits").join(walked, key).join(cut.select(*key, "conv_id"), key)
    said = F.concat(F.col("edits")[F.col("state")], F.col("tail"))
    parts = F.sort_array(F.collect_list(F.struct("part", "at", said.alias("said"))))  # an audit is one cell of the result, as long as its conversation
    return chosen.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["said"]), "").alias("audit"))


def judge(rows: DataFrame, costs: Costs | None = None, piece: int = PIECE) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit. ``rows`` hold conv_id, turn, role and
    text, and n, the times each stands there (1 where there is no such column; 0 keeps the conversation listed)."""
    integer_id(rows, "turn")
    c = costs or Costs()
    if "n" not in rows.columns:
        rows = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))
    slim = materialize(faults(rows), "conversation-faults")
    cut = materialize(pieces(slim, piece), "conversation-pieces")
    first = F.min(F.struct("part", "at"))
    edges = cut.where("edge").groupBy("conv_id").agg(F.count("*").alias("pieces"), first["part"].alias("head"), first["at"].alias("head_at")).where("pieces > 1")
    edges = materialize(edges.withColumnRenamed("conv_id", "split_id"), "conversation-edges")
    inside = cut["conv_id"].eqNullSafe(edges["split_id"])
    solved = _whole(cut.join(edges, inside, "left_anti"), c).unionByName(_split(cut.join(edges, inside), c)).withColumnRenamed("conv_id", "solved_id")
    counts = _counts(slim)
    both = counts.join(solved, counts["conv_id"].eqNullSafe(solved["solved_id"]), "left")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))


_NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def _played(stream: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of repaired rows, and (conv_id, None, None) where a conversation begins, from (conv_id, audit or
    None, role, text, n) with each conversation's audit first."""
    edits, last, conv = iter(()), "", None

    def written() -> Iterator[tuple]:
        nonlocal last
        for e in edits:
            if e == "I":
                role, last = _NEXT[last], _NEXT[last][0]
                yield conv, role, ""
            else:
                yield e
                return

    for own, audit, role, text, n in stream:
        if audit is not None:
            yield from written()  # what the conversation before still lacks
            conv, last, edits = own, "", iter(audit)
            yield conv, None, None
            continue
        for _ in range(n):
            for e in written():
                if isinstance(e, tuple):
                    yield e
                elif e != "D":
                    role = _NEXT[last] if e == "R" else role
                    last = role[0]
                    yield conv, role, text
    yield from written()


def _streamed(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows behind the audits of their conversations, one task a conversation, in their order."""
    texts = rows.where("n > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", *_hashes(), "role", "text", "n")
    heads = judged.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", rows.schema["turn"].dataType), ("h1", "long"), ("h2", "long"), ("role", "string"), ("text", "string"), ("n", "long"))])
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "h1", "h2").select("conv_id", "audit", "role", "text", "n")


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def digests(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): sha256 of the repaired rows as ``role:text``, joined by line ends."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, hasher, fresh = [], [], None, True

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])

        for conv, role, text in _played(_tuples(batches)):
            if role is None:
                if hasher:
                    sums.append(hasher.hexdigest())
                if len(sums) >= 4096:
                    yield out()
                    ids, sums = [], []
                ids.append(conv)
                hasher, fresh = hashlib.sha256(), True
            else:
                hasher.update((("" if fresh else "\n") + role + ":").encode())
                hasher.update(text.encode())
                fresh = False
        if hasher:
            sums.append(hasher.hexdigest())
            yield out()

    return _streamed(rows, judged).mapInArrow(run, _schema(kind, "repaired_sha256 string"))


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, role, text)."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string()], ["conv_id", "place", "role", "text"]
        held, size, place = [], 0, 0
        for conv, role, text in _played(_tuples(batches)):
            if role is None:
                place = 0
                continue
            held.append((conv, place, role, text))
            place, size = place + 1, size + len(text)
            if len(held) >= 4096 or size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return _streamed(rows, judged).mapInArrow(run, _schema(kind, "place long, role string, text string"))
