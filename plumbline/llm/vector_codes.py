"""Vector code compression: product codes whose entries are found by annular norm pruning, in whole numbers.

A vector's components are scaled and floored to integers and cut into equal consecutive parts. Each part position has a
codebook that starts with the parts of the least ids and is moved by rounds of assigning and averaging. To assign a part,
the codebook's entries stand sorted by norm. The entry of the nearest norm is measured first; as no entry whose norm
differs by more than the best distance can be nearer, a binary search gives the annulus of norms that is left, and only
its entries are measured, inclusively, while every better distance narrows it further. Results are exact: the same
as measuring all entries, ties to the lower index.

Vectors are read once into a table of integers in the shared folder. A round is one pass over it; tasks return sums of
their rows (entries x parts rows each, whatever their input), which Spark adds up, and the codebooks, entries x width
numbers, go out with the next pass. No vector is shuffled. Sums are integers, so neither partitions nor lost tasks change
a result.

Defined cases: vectors that are null or hold null or non-finite components are left out (not coded); vectors of another
width than the first kept one, a width that ``parts`` doesn't divide, and components beyond 2**27 after scaling, whose
distances would not fit a long, raise ValueError; fewer vectors than entries make smaller codebooks; repeated ids are
ordered by their vectors, null ids come last; equal vectors get equal codes; an empty table gives an empty result. Columns
of the caller stay, whatever their names, but for those named like results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, packed, unpacked

RESULT = ["code", "error"]
#: Components may be so large after scaling.
MOST = 1 << 27


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite components alone."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def whole_numbers(vector: str, scale: int) -> F.Column:
    return F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))


class Codebook:
    """The entries of one part position, findable by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norm = np.sqrt(np.einsum("ij,ij->i", entries, entries).astype(np.float64))
        self.order = np.argsort(norm, kind="stable")
        self.sorted, self.norm = entries[self.order], norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``x``."""
        n, k = len(x), len(self.norm)
        rows, norm = np.arange(n), np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
        right = np.clip(np.searchsorted(self.norm, norm), 1, k - 1) if k > 1 else np.zeros(n, np.int64)
        at = np.where(norm - self.norm[right - 1] <= self.norm[right] - norm, right - 1, right) if k > 1 else right
        best, entry = self._measure(x, at), self.order[at]
        down, up = at - 1, at + 1
        low, high = self._annulus(norm, best)
        while True:
            moved = False
            for step in (-1, 1):
                place = down if step < 0 else up
                inside = rows[(place >= low) & (place < high)]
                if len(inside):
                    moved = True
                    own, index = self._measure(x[inside], place[inside]), self.order[place[inside]]
                    better = (own < best[inside]) | ((own == best[inside]) & (index < entry[inside]))
                    won = inside[better]
                    best[won], entry[won] = own[better], index[better]
                    low[won], high[won] = self._annulus(norm[won], best[won])
                    place[inside] += step
            if not moved:
                return entry, best

    def _measure(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        apart = x - self.sorted[place]
        return np.einsum("ij,ij->i", apart, apart)

    def _annulus(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose norms differ by the best distance at most, with room for the rounding of roots."""
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + norm * 1e-9 + 1e-6
        return np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")


Books = list[np.ndarray]  # by part position: [entry, place within the part]


def _grid(batch: pa.Array, width: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(grid: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, (book, part) in enumerate(zip(books, np.split(grid, len(books), axis=1), strict=True)):
        yield p, part, *book.nearest(part)


def _moved(table: DataFrame, books: Books) -> Books:
    """One round: every entry goes to the floored mean of the parts nearest to it; unused ones stay."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for p, part, entry, _ in _assigned(_grid(batch.column(0), width), found):
                np.add.at(sums[p], entry, part)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["part", "entry", "n", "sums"])

    parts = table.select("_vector").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    size = max(b.shape[1] for b in books)
    total = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(size)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in total.collect():  # parts x entries rows
        out[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def _numbers(df: DataFrame, key: str, vector: str, s: Settings) -> tuple[DataFrame, list[str], int]:
    """The kept rows, packed, with their integers as ``_vector``, written once; and the vectors' width."""
    own = kept(df, vector)
    rows, names = packed(own, own[f"`{key}`"].alias("_key"), whole_numbers(vector, s.scale).alias("_vector"), without=RESULT)
    table = materialize(rows, "vectors")
    wide = table.agg(F.min(F.size("_vector")).alias("least"), F.max(F.size("_vector")).alias("most"), F.max(F.array_max(F.transform("_vector", F.abs))).alias("largest")).first()
    if wide["least"] is None:
        return table, names, 0
    if wide["least"] != wide["most"] or wide["most"] == 0 or wide["most"] % s.parts:
        raise ValueError(f"vectors of {wide['least']} to {wide['most']} components; one width is needed that {s.parts} parts divide")
    if wide["largest"] > MOST:
        raise ValueError(f"a component of {wide['largest']} after scaling; {MOST} is the most whose distances fit a long")
    return table, names, wide["most"]


def _train(table: DataFrame, width: int, s: Settings) -> Books:
    if not width:
        return []
    first = table.orderBy(F.col("_key").asc_nulls_last(), "_vector").select("_vector").limit(s.entries).collect()
    books: Books = np.split(np.array([r["_vector"] for r in first], np.int64), s.parts, axis=1)
    for _ in range(s.rounds):
        books = _moved(table, books)
    return books


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> Books:
    """The codebooks of all kept rows, by part position; none of an empty table."""
    s = settings or Settings()
    table, _, width = _numbers(df, key, vector, s)
    return _train(table, width, s)


def _encode(table: DataFrame, names: list[str], books: Books) -> DataFrame:
    width = sum(b.shape[1] for b in books)
    schema = T.StructType().add("code", "string").add("error", "long")

    @F.arrow_udf(schema)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = [Codebook(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            if not found:
                yield pa.array([None] * len(batch), pa.struct([("code", pa.string()), ("error", pa.int64())]))
                continue
            code, error = np.full(len(batch), "", "U1").astype(object), np.zeros(len(batch), np.int64)
            for _, _, entry, best in _assigned(_grid(batch, width), found):
                code, error = code + digits[entry].astype(object), error + best
            yield pa.StructArray.from_arrays([pa.array(code.tolist(), pa.string()), pa.array(error)], names=["code", "error"])

    return table.select(*unpacked(names), coded("_vector").alias("_coded")).select(*[F.col(f"`{n}`") for n in names], "_coded.code", "_coded.error")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> tuple[DataFrame, Books]:
    """The kept rows of ``df`` with code (two hex digits a part) and error (squared distance), and the codebooks."""
    s = settings or Settings()
    if s.entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    table, names, width = _numbers(df, key, vector, s)
    books = _train(table, width, s)
    return _encode(table, names, books), books


def fingerprint(books: Books) -> str:
    """sha256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def error_by(coded: DataFrame, label: str, result: str = "label_error") -> DataFrame:
    """``coded``, written once, with the errors summed over rows of an equal label, nulls together. Sums are made before
    rows move."""
    coded = materialize(coded, "vector-codes")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias(result))
    return coded.join(sums, coded[label].eqNullSafe(sums["_label"])).drop(sums["_label"])


def oracle(s: Settings, table: str = "embeddings") -> str:
    """The same in DuckDB SQL, every entry measured."""
    near = "arg_min(e, d * 65536 + e) AS e, min(d) AS d"
    apart = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)])::BIGINT AS d"
    steps = []
    for i in range(s.rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, {near} FROM (SELECT r, parts.p, x, e, {apart} FROM parts JOIN b{i} ON parts.p = b{i}.p) GROUP BY r, p)")
        if i < s.rounds:
            steps.append(
                f"m{i} AS (SELECT p, e, list(v ORDER BY j) AS c FROM (SELECT p, e, j, ((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v "
                f"FROM a{i}, generate_series(1, len(x)) AS t(j) GROUP BY p, e, j) GROUP BY p, e), "
                f"b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} ON b{i}.p = m{i}.p AND b{i}.e = m{i}.e)"
            )
    last = s.rounds
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
 SELECT vec_id, label, [floor({s.scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM {table}
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
 parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {s.parts}) + 1:(p + 1) * (len(v) // {s.parts})] AS x FROM kept, range({s.parts}) AS t(p)),
 b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {s.entries}),
 {", ".join(steps)},
 coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r),
 print AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
 FROM kept JOIN coded USING (r), print"""
