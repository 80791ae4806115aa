"""Exact substring removal by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Which suffixes must be
sorted is cut down first: among the ``length - gram + 1`` grams of a window the one of least hash is its anchor,
equal windows have equal anchors at equal places, so only suffixes that start at an anchor matter, and of those
only the ones whose anchor gram occurs twice or more. Each carries what stands left of it and the windows it
answers for.

These suffixes are sorted where they are read; runs are front-coded (a suffix stores its common prefix with the
one before and the rest) and exchanged by ranges of the gram's hash, so suffixes that share a gram meet. There a
loser tree merges the runs: every candidate knows its common prefix with the last winner, candidates of unequal
prefixes are ordered by that number alone, and known prefixes are never compared again. The merge gives the
common prefix of neighbours; suffixes that share ``length - l`` bytes form an interval, so do those that share
``l`` bytes to the left, and a window that starts ``l`` bytes before its anchor repeats just if another suffix is
in both of its intervals.

A gram of more than ``hot`` occurrences would put as many suffixes into one task. The windows that such a gram answers
for are compared by 128-bit hashes of their bytes instead: counted by partial sums and joined back, all of them, by
exchanges that spill. That costs a row for each window, and no task holds a group.

Defined cases: a null text is no bytes; texts under ``length`` bytes lose nothing; a string may repeat within one
document; rows equal in doc_id and text count as two occurrences each and get one result; an empty table gives no
rows; very long texts are taken in stretches while anchors are sought, and whole when they are cut; ids are integers,
others are refused; of other columns none is read or returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_id, materialize, pieces

RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
_BASE = 0x9E3779B97F4A7C15
#: Bits for a place in the least-hash keys; a text has at most 2**31 - 1 bytes.
_PLACE = np.uint64(31)


@dataclass(frozen=True)
class Shape:
    length: int = 200
    gram: int = 48
    #: Bytes of suffixes in a run, and suffixes that one range of the exchange is meant to hold.
    run_bytes: int = 24 << 20
    range_rows: int = 60_000
    seed: int = 5
    #: Occurrences of a gram up to which its suffixes are merged in one task.
    hot: int = 20_000
    #: Window starts of a text that are looked at together.
    stretch: int = 2 << 20

    @property
    def width(self) -> int:
        """Grams in a window."""
        return self.length - self.gram + 1


class Anchors:
    """Anchors of many texts at once."""

    def __init__(self, s: Shape, room: int = 4 << 20):
        self.s = s
        self.codes = np.random.default_rng(s.seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.grow(room)

    def grow(self, n: int) -> None:
        self.up = self.powers(_BASE, n)
        self.down = self.powers(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def find(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """``data`` joins texts that begin at ``starts``. Returns (hash, anchor, first, last): each anchor's gram
        hash, its place in ``data``, and the first and last window start it answers for."""
        s, n = self.s, len(data)
        none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        if n < s.length:
            return none
        if n >= len(self.up):
            self.grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[np.frombuffer(data, np.uint8)] * self.up[:n], out=sums[1:])
        grams = n - s.gram + 1
        h = (sums[s.gram :] - sums[:grams]) * self.down[:grams]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # Least of each window of ``width`` grams: minima from block borders, place in the low bits.
        key = h >> _PLACE << _PLACE | np.arange(grams, dtype=np.uint64)
        w = s.width
        pad = np.full(-(-grams // w) * w, np.iinfo(np.uint64).max, np.uint64)
        pad[:grams] = key
        blocks = pad.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - s.length + 1
        least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
        owner = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        # Windows across a text's end answer for nothing.
        cross = np.zeros(windows + 1, np.int32)
        ends = np.append(starts[1:], n)
        np.add.at(cross, np.clip(np.maximum(ends - s.length + 1, starts), 0, windows), 1)
        np.add.at(cross, np.clip(ends, 0, windows), -1)
        good = np.cumsum(cross)[:windows] == 0
        change = np.flatnonzero((owner[1:] != owner[:-1]) | (good[1:] != good[:-1])) + 1
        first = np.concatenate([[0], change])
        last = np.append(change, windows) - 1
        kept = good[first]
        first, last = first[kept], last[kept]
        at = owner[first]
        return h[at], at, first, last


def pack(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return at << 16 | lo << 8 | hi


def anchor_rows(docs: DataFrame, s: Shape) -> DataFrame:
    """gram (hash), _id, _text, spot (place, least and greatest distance of a window's start, packed).

    A text is taken in stretches of ``stretch`` window starts, each with the bytes its last window needs, so that the work
    arrays stay small whatever its length; an anchor at a border answers once on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(s)
        for batch in pieces(batches, "text", 2 << 20):
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_text"))
            for group in _stretches((x.as_py() or "").encode() for x in batch.column("text")):
                row, base, parts = zip(*group, strict=True)
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                starts = np.cumsum(sizes) - sizes
                h, at, first, last = finder.find(b"".join(parts), starts)
                part = np.searchsorted(starts, at, side="right") - 1
                spot = pack(at - starts[part] + np.array(base, np.int64)[part], at - last, at - first)
                doc = np.array(row, np.int64)[part]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(hashes[doc]), pa.array(spot)], names=["gram", "_id", "_text", "spot"])

    def _stretches(texts: Iterable[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(row, first byte, bytes) of texts and stretches, in lists of a few stretches' bytes."""
        held, size = [], 0
        for row, data in enumerate(texts):
            for a in range(0, max(1, len(data) - s.length + 1), s.stretch):
                part = data[a : a + s.stretch + s.length - 1]
                if held and size + len(part) > s.stretch:
                    yield held
                    held, size = [], 0
                held.append((row, a, part))
                size += len(part)
        if held:
            yield held

    return docs.select("_id", "_text", "text").mapInArrow(run, "gram long, _id long, _text long, spot long")


# ---- runs: sorted suffixes, front-coded


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n, i = min(len(a), len(b)), known
    while i < n and a[i : i + 16] == b[i : i + 16]:
        i += 16
    i = min(i, n)
    end = min(i + 16, n)
    while i < end and a[i] == b[i]:
        i += 1
    return min(i, n)


def neighbours(strings: list[bytes], width: int) -> np.ndarray:
    """Common prefix of each string with the one before it, 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for i in range(0, len(strings), 20_000):
        part = strings[max(0, i - 1) : i + 20_000]
        if len(part) < 2:
            continue
        m = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in part]), np.uint8).reshape(-1, width)
        differ = m[1:] != m[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        out[max(1, i) : max(1, i) + len(part) - 1] = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
    return out


#: A suffix: its bytes, the bytes before it reversed, doc_id, text hash, place, lo, hi.
Suffix = tuple[bytes, bytes, int, int, int, int, int]


def pack_run(entries: list[Suffix], s: Shape) -> bytes:
    """Front-code sorted suffixes, and the bytes left of them against the entry before; compress the block."""
    right, left = [e[0] for e in entries], [e[1] for e in entries]
    same, same_left = neighbours(right, s.length), neighbours(left, s.width)
    small = np.array([same, [len(x) for x in right], same_left, [len(x) for x in left], [e[5] for e in entries], [e[6] for e in entries]], np.uint8)
    numbers = np.array([[e[2] for e in entries], [e[3] for e in entries], [e[4] for e in entries]], np.int64)
    rest = b"".join([x[k:] for x, k in zip(right, same.tolist(), strict=True)]) + b"".join([x[k:] for x, k in zip(left, same_left.tolist(), strict=True)])
    return zstandard.ZstdCompressor(level=3).compress(len(entries).to_bytes(8, "little") + small.tobytes() + numbers.tobytes() + rest)


def open_run(blocks: Iterable[bytes]) -> Iterator[tuple[int, Suffix]]:
    """(common prefix with the suffix before, suffix) of a run, block after block."""
    right = left = b""
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int.from_bytes(raw[:8], "little")
        same, size, same_left, size_left, lo, hi = np.frombuffer(raw, np.uint8, 6 * n, 8).reshape(6, n).tolist()
        docs, texts, at = np.frombuffer(raw, np.int64, 3 * n, 8 + 6 * n).reshape(3, n).tolist()
        i = 8 + 30 * n
        j = i + sum(size) - sum(same)
        for k in range(n):
            before, a, b = right, size[k] - same[k], size_left[k] - same_left[k]
            right, left = right[: same[k]] + raw[i : i + a], left[: same_left[k]] + raw[j : j + b]
            i, j = i + a, j + b
            # A block stores its first suffix whole.
            yield same[k] if k else common(before, right), (right, left, docs[k], texts[k], at[k], lo[k], hi[k])


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """A loser tree over sorted runs -> (common prefix with the suffix before, suffix) in order.

    ``known[i]`` is the common prefix of run i's suffix with the last winner, for the losers on the winner's path:
    of two, the longer known prefix is smaller; only for equal ones are bytes compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    now: list[Suffix | None] = [None] * k
    known = [0] * k
    for i, r in enumerate(runs):
        if (x := next(r, None)) is not None:
            now[i] = x[1]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        p, q = x[0], y[0]
        n = common(p, q, known[a])
        if n == len(q) and n < len(p) or n < len(q) and n < len(p) and q[n] < p[n]:
            a, b = b, a
        known[b] = n
        return a, b

    best = list(range(k))  # the first round, level by level
    node = k
    while len(best) > 1:
        node //= 2
        up = []
        for i in range(0, len(best), 2):
            win, lose = play(best[i], best[i + 1])
            losers[node + i // 2] = lose
            up.append(win)
        best = up
    top = best[0]
    while now[top] is not None:
        yield known[top], now[top]  # type: ignore[misc]
        x = next(runs[top], None)
        now[top], known[top] = (None, 0) if x is None else (x[1], x[0])
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


# ---- the stages


def sorted_runs(candidates: DataFrame, s: Shape, ranges: int) -> DataFrame:
    """range, run, seq, block: each task's suffixes sorted, cut by range of the gram hash, front-coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, unzip = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        held: list[list[Suffix]] = [[] for _ in range(ranges)]
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for r, entries in enumerate(held):
                if entries:
                    entries.sort(key=itemgetter(0))
                    rows += [(r, task << 32 | count, q, pack_run(entries[i : i + 20_000], s)) for q, i in enumerate(range(0, len(entries), 20_000))]
                    entries.clear()
            cols = zip(*rows, strict=True) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["range", "run", "seq", "block"])

        for batch in batches:
            for doc, text_hash, packed, spots in zip(*batch.columns, strict=True):
                data = unzip.decompress(packed.as_py())
                ids = (doc.as_py(), text_hash.as_py())
                # The low bits deal the ranges: anchors are least hashes, so their high bits are mostly 0.
                for gram, spot, hot in zip(*(spots.values.field(c).to_pylist() for c in ("gram", "spot", "hot")), strict=True):
                    if hot:
                        continue
                    at, lo, hi = spot >> 16, spot >> 8 & 255, spot & 255
                    held[((gram & (1 << 32) - 1) * ranges) >> 32].append((data[at : at + s.length - lo], data[at - hi : at][::-1], *ids, at, lo, hi))
                size += 300 * len(spots.values)
            if size > s.run_bytes:
                yield flush()
                count, size = count + 1, 0
        yield flush()

    return candidates.select("_id", "_text", "packed", "spots").mapInArrow(run, "range int, run long, seq int, block binary")


def repeated_windows(entries: list[Suffix], lcp: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of merged suffixes with the common prefix of neighbours: (index, distance) of each window that repeats."""
    n = len(entries)
    left = [e[1] for e in entries]
    order = sorted(range(n), key=left.__getitem__)
    left_lcp = neighbours([left[i] for i in order], s.width)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lo = np.fromiter((e[5] for e in entries), np.int64, n)
    hi = np.fromiter((e[6] for e in entries), np.int64, n)
    found_i, found_l = [], []
    for d in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        who = np.flatnonzero((lo <= d) & (d <= hi))
        if len(who) < 2:
            continue
        right_of = np.cumsum(lcp < s.length - d)[who]
        left_of = np.cumsum(left_lcp < d)[place[who]]
        key = right_of << 32 | left_of
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(who), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        found_i.append(who[twice])
        found_l.append(np.full(int(twice.sum()), d))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_l)


def merged_spans(runs: DataFrame, s: Shape, ranges: int) -> DataFrame:
    """_id, _text, span (first byte << 20 | bytes, of joined repeated windows)."""

    def spans_of(entries: list[Suffix], lcps: list[int]) -> pa.RecordBatch:
        i, d = repeated_windows(entries, np.array(lcps, np.int64), s)
        start = np.fromiter((e[4] for e in entries), np.int64, len(entries))[i] - d
        order = np.lexsort((start, i))
        i, start = i[order], start[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(i)) - 1
        who, begin, size = i[first].tolist(), start[first], (start[last] - start[first] + s.length if len(i) else start)
        docs, texts = [entries[k][2] for k in who], [entries[k][3] for k in who]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(begin << 20 | size, pa.int64())], names=["_id", "_text", "span"])

    def one_range(blocks: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        entries: list[Suffix] = []
        lcps: list[int] = []
        for lcp, e in merge([open_run(b) for b in blocks.values()]):
            if lcp < s.gram and len(entries) >= 30_000:
                yield spans_of(entries, lcps)
                entries, lcps = [], []
            entries.append(e)
            lcps.append(lcp)
        if entries:
            yield spans_of(entries, lcps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, {}
        for batch in batches:
            for r, run_id, _, block in zip(*batch.columns, strict=True):
                if r.as_py() != now and blocks:
                    yield from one_range(blocks)
                    blocks = {}
                now = r.as_py()
                blocks.setdefault(run_id.as_py(), []).append(block.as_py())
        if blocks:
            yield from one_range(blocks)

    dealt = runs.repartition(ranges, "range").sortWithinPartitions("range", "run", "seq")
    return dealt.select("range", "run", "seq", "block").mapInArrow(run, "_id long, _text long, span long")


def squeezed(text: str) -> Column:
    """The text's bytes, compressed, since they are shuffled."""
    return F.arrow_udf(_squeeze, T.BinaryType())(F.col(text))


def _squeeze(texts: pa.Array) -> pa.Array:
    coder = zstandard.ZstdCompressor(level=3)
    return pa.array([coder.compress((x.as_py() or "").encode()) for x in texts], pa.binary())


def removed_spans(docs: DataFrame, s: Shape | None = None) -> DataFrame:
    """_id, _text, spans: the packed spans of each document that loses bytes. ``docs`` has _id, _text and text."""
    s = s or Shape()
    doc = ["_id", "_text"]
    spots = anchor_rows(docs, s)
    # Written first, so that both sides of the join are plain exchanges, of which a hot gram's can be split.
    grams = spots.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > s.hot).alias("hot"))
    flagged = spots.join(materialize(grams, "suffix-grams"), "gram").groupBy(*doc).agg(F.collect_set(F.struct("gram", "spot", "hot")).alias("spots"))
    flagged = materialize(flagged, "suffix-spots")
    merged, hot = flagged.agg(F.sum(F.size(F.filter("spots", lambda x: ~x["hot"]))), F.max(F.exists("spots", lambda x: x["hot"]))).first()
    ranges = max(1, math.ceil((merged or 0) / s.range_rows))
    candidates = docs.select(*doc, squeezed("text").alias("packed")).join(flagged, doc)
    if hot:  # both ways read the texts, which move once
        candidates = materialize(candidates, "suffix-texts")
    spans = merged_spans(sorted_runs(candidates, s, ranges), s, ranges)
    if hot:
        spans = spans.unionByName(hashed_spans(candidates, s))
    return materialize(spans.groupBy("_id", "_text").agg(F.collect_list("span").alias("spans")), "suffix-spans")


def hashed_spans(candidates: DataFrame, s: Shape) -> DataFrame:
    """_id, _text, span of each window under hot spots whose bytes stand elsewhere, by hashes of whole windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, text_hash, packed, found in zip(*batch.columns, strict=True):
                data, spots = unzip.decompress(packed.as_py()), found.values.to_numpy(zero_copy_only=False)
                at, lo, hi = spots >> 16, spots >> 8 & 255, spots & 255
                starts = np.unique(np.concatenate([np.arange(a - h, a - x + 1) for a, x, h in zip(at, lo, hi, strict=True)]))
                n = len(starts)
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + s.length]) for i in starts.tolist()]), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, pa.int64()), pa.array([text_hash.as_py()] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["_id", "_text", "start", "a", "b"])

    hot = F.transform(F.filter("spots", lambda x: x["hot"]), lambda x: x["spot"])
    texts = candidates.select("_id", "_text", "packed", hot.alias("spots")).where(F.size("spots") > 0)
    windows = materialize(texts.mapInArrow(run, "_id long, _text long, start long, a long, b long"), "suffix-windows")
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    return windows.join(twice, ["a", "b"]).select("_id", "_text", (F.shiftleft("start", 20) + s.length).alias("span"))


def cut(data: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """(kept bytes, maximal removed runs) for packed spans in any order."""
    if not len(spans):
        return data, []
    begin = np.sort(spans) >> 20
    end = begin + (np.sort(spans) & (1 << 20) - 1)
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    runs = list(zip(begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(new)) - 1].tolist(), strict=True))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), runs


def dedup(docs: DataFrame, s: Shape | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of first byte, end) per document."""
    integer_id(docs, "doc_id")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    spans = removed_spans(rows, s)
    both = rows.select("doc_id", "_id", "_text", squeezed("text").alias("packed")).join(spans, ["_id", "_text"], "left").select("doc_id", "packed", "spans")
    schema = docs.select("doc_id").withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit(""), "spans": F.array(F.array(F.lit(0).cast("long")))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column("packed"), batch.column("spans"), strict=True):
                data = unzip.decompress(packed.as_py())
                kept, runs = cut(data, np.array(spans.as_py() or [], np.int64))
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [list(r) for r in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", *RESULT])

    return both.mapInArrow(run, schema)
