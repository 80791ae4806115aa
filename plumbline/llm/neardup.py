"""Near-duplicate documents by MinHash.

A document is the set of its word shingles. Many universal hash minima make its signature, bands of the signature
its buckets; documents with equal sets are one node. A bucket's pivot, its most central member, is compared with
all others on the full sets, which also tells for each member what it lacks of the pivot and has beyond it, as bit
sets. Links give components by alternating large-star and small-star. In a bucket whose members are then not all
in one component, those outside the pivot's are held against every member of another component: the bit sets bound
the intersection from above, pairs whose bound is too low never become rows, and the rest is verified by signature
and then on the full sets. So every pair of a bucket that could join two components is decided, while no group
meets in one task and a family of near copies costs one comparison a member.

Defined cases: null or empty text and text without words have an empty set and link with nothing; texts with
fewer words than a shingle are one shingle; rows with one doc_id are one document; a null doc_id links nothing
of itself and gets its copies' component (null if they have none); ids are integers, others are refused; very long texts
have full sets, made one text at a time; an empty table gives no rows. Of other
columns ``link`` reads none and ``keep_one`` returns all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_id, materialize, pieces
from .components import components


@dataclass(frozen=True)
class Settings:
    """A pair at ``similarity`` 0.8 shares no bucket with probability (1 - 0.8**rows)**bands, 5e-6 here."""

    words: int = 5
    similarity: tuple[int, int] = (80, 100)  # per hundred: intersection * 100 >= union * 80
    bands: int = 40
    rows: int = 6
    seed: int = 7

    @property
    def signature_floor(self) -> float:
        """Agreement that a linked pair's signature falls below with probability under 1e-9 (6 deviations)."""
        j, n = self.similarity[0] / self.similarity[1], self.bands * self.rows
        return j - 6 * (j * (1 - j) / n) ** 0.5


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles; A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh3_64_intdigest(flat)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


class MinHash:
    """h(x) = a * low(x) + high(x) modulo 2**32, over the halves of the shingle's hash: one ``a`` for each minimum."""

    def __init__(self, s: Settings):
        self.s = s
        self.a = np.random.default_rng(s.seed).integers(0, 2**32, s.bands * s.rows, dtype=np.uint32) | np.uint32(1)

    def signature(self, x: np.ndarray) -> np.ndarray:
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            h = self.a[:, None] * low[i : i + 512]
            h += high[i : i + 512]
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def buckets(self, signature: np.ndarray) -> list[int]:
        """A signed 64-bit hash of each band and its number."""
        rows = signature.reshape(self.s.bands, self.s.rows)
        return [_signed(xxhash.xxh3_64_intdigest(r.tobytes(), seed=i)) for i, r in enumerate(rows)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits of the set's hash), buckets, signature (a byte for each minimum)."""
    schema = docs.select("doc_id").schema
    for name, kind in (("n_shingles", T.LongType()), ("set_a", T.LongType()), ("set_b", T.LongType()), ("buckets", T.ArrayType(T.LongType())), ("signature", T.BinaryType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(s)
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text"):
                x = shingles(text.as_py(), s.words)
                if not len(x):
                    rows.append((0, None, None, None, None))
                    continue
                whole = xxhash.xxh3_128_intdigest(x.tobytes())
                signature = hashes.signature(x)
                rows.append((len(x), _signed(whole >> 64), _signed(whole & (1 << 64) - 1), hashes.buckets(signature), signature.astype(np.uint8).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """node, members: the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(x.as_py(), s.words).tobytes() for x in batch.column("text")], pa.binary())], names=["node", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, members binary")


#: 64-bit words of a bit set of shingles.
BIT_WORDS = 8
_LACKS, _HAS = [f"m{i}" for i in range(BIT_WORDS)], [f"e{i}" for i in range(BIT_WORDS)]


def side(t: DataFrame, name: str, *columns: str) -> DataFrame:
    return t.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def bit_set(x: np.ndarray) -> list[int]:
    """Shingles as bits: at most as many as shingles, since two may share one."""
    flags = np.zeros(64 * BIT_WORDS, np.uint8)
    flags[(x % np.uint64(64 * BIT_WORDS)).astype(np.int64)] = 1
    return np.packbits(flags).view(">i8").tolist()


def against_pivot(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, x) -> with n_p, n, both, extra, hidden and the bit sets of p - x and x - p (``hidden``: shingles of x - p
    that share their bit with another)."""
    columns = ["p", "x", "n_p", "n", "both", "extra", "hidden", *_LACKS, *_HAS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, x, a, b in zip(*batch.columns, strict=True):
                u, v = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                lacks, has = np.setdiff1d(u, v, assume_unique=True), np.setdiff1d(v, u, assume_unique=True)
                bits = bit_set(has)
                hidden = len(has) - sum((w & (1 << 64) - 1).bit_count() for w in bits)
                rows.append((p.as_py(), x.as_py(), len(u), len(v), len(u) - len(lacks), len(has), hidden, *bit_set(lacks), *bits))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(columns))], names=columns)

    # Pivots are few: their sets alone are dealt by pivot, and a pair carries its member's set there.
    pivots = only(sets, "node", pairs.select(F.col("p").alias("node")).distinct())
    full = pairs.join(side(sets, "x", "members"), "x").join(side(pivots, "p", "members"), "p")
    return full.select("p", "x", "p_members", "x_members").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def could_link(s: Settings) -> str:
    """SQL over two members a and b of one pivot: whether the bound of their intersection leaves them a link.

    Both lack at least the bits of either's lacks; beyond the pivot they share at most the common bits and what
    hides behind a bit in one of them."""
    num, den = s.similarity
    lacks = " + ".join(f"bit_count(a.{c} | b.{c})" for c in _LACKS)
    has = " + ".join(f"bit_count(a.{c} & b.{c})" for c in _HAS)
    most = f"(a.n_p - ({lacks}) + least({has} + least(a.hidden, b.hidden), a.extra, b.extra))"
    return f"{den} * {most} >= {num} * (a.n + b.n - {most})"


def linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (p, x) whose signatures and then full sets agree, as (u, v)."""
    floor, (num, den) = s.signature_floor, s.similarity

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float((np.frombuffer(x.as_py(), np.uint8) == np.frombuffer(y.as_py(), np.uint8)).mean()) >= floor for x, y in zip(a, b, strict=True)], pa.bool_())

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(den * both >= num * (len(u) + len(v) - both))
        return pa.array(out, pa.bool_())

    first = pairs.join(side(nodes, "p", "signature"), "p").join(side(nodes, "x", "signature"), "x")
    first = first.where(alike("p_signature", "x_signature")).select("p", "x")
    full = first.join(side(sets, "p", "members"), "p").join(side(sets, "x", "members"), "x")
    return full.where(close("p_members", "x_members")).select(F.col("p").alias("u"), F.col("x").alias("v"))


def only(df: DataFrame, column: str, wanted: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``column`` is a node of ``wanted``, which is broadcast up to ``most`` numbers."""
    wanted = wanted.select(F.col("node").alias(column))
    return df.join(F.broadcast(wanted) if wanted.count() <= most else wanted, column, "left_semi")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node of buckets with two members or more; of buckets with the same members one stays."""
    # Counted by partial sums and joined back to a side with unique keys, so a hot bucket can be split.
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(shared, "bucket"), "neardup-shared")
    marks = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"f{k}") for k in (1, 2)]
    kept = rows.groupBy("bucket", "n").agg(*marks).groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket"))
    return rows.join(kept.select("bucket"), "bucket")


def link(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept, one row per document."""
    s = s or Settings()
    num, den = s.similarity
    integer_id(docs, "doc_id")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(base, s), "neardup-signed")
    same = materialize(signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "neardup-sets")
    heads = same.where("node is not null").select(F.col("node").alias("doc_id"), "set_a", "set_b")
    nodes = signed.select("doc_id", "set_a", "set_b", "buckets").join(heads, ["doc_id", "set_a", "set_b"], "left_semi").select(F.col("doc_id").alias("node"), "buckets")

    members = materialize(shared_buckets(nodes).distinct(), "neardup-buckets")
    wanted = materialize(members.select("node").distinct(), "neardup-wanted")
    nodes = materialize(only(signed, "doc_id", wanted).where("n_shingles > 0").select(F.col("doc_id").alias("node"), "signature").distinct(), "neardup-nodes")
    sets = full_sets(only(base, "doc_id", wanted), s)
    if signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        sets = sets.distinct()  # repeated rows have one set
    sets = materialize(sets, "neardup-full")

    # The most central member, by the sizes of its buckets, is each bucket's pivot.
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = members.join(central, "node").groupBy("bucket").agg((-F.max(F.struct(F.col("weight"), (-F.col("node")).alias("least")))["least"]).alias("p"))
    members = materialize(members.join(pivots, "bucket").select("bucket", "p", F.col("node").alias("x")), "neardup-members")
    known = materialize(against_pivot(members.select("p", "x").distinct(), sets), "neardup-pivots")
    edges = known.where((F.col("p") != F.col("x")) & (den * F.col("both") >= num * (F.col("n_p") + F.col("n") - F.col("both")))).select(F.col("p").alias("u"), F.col("x").alias("v"))
    # Rows that share a doc_id are one document: its sets are linked as well.
    repeated = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("set_a", "set_b").alias("n")).where("n > 1").select("doc_id")
    repeated = signed.join(repeated, "doc_id").join(same, ["set_a", "set_b"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v")
    labels = components(edges.unionByName(repeated).distinct())

    label = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    rest = members.join(label("x", "x_label"), "x", "left").withColumn("x_label", F.coalesce("x_label", "x"))
    mixed = rest.groupBy("bucket").agg(F.min("x_label").alias("lo"), F.max("x_label").alias("hi")).where("lo <> hi").select("bucket")
    rest = rest.join(mixed, "bucket").join(label("p", "p_label"), "p", "left").withColumn("p_label", F.coalesce("p_label", "p"))
    rest = materialize(rest.join(known, ["p", "x"]), "neardup-rest")
    outside = rest.where("x_label <> p_label")
    pairs = rest.alias("b").join(outside.alias("a"), F.expr(f"a.bucket = b.bucket and a.x_label <> b.x_label and (b.x_label = b.p_label or a.x < b.x) and {could_link(s)}"))
    pairs = pairs.select(F.least("a.x", "b.x").alias("p"), F.greatest("a.x", "b.x").alias("x")).distinct()
    more = materialize(linked(pairs, nodes, sets, s), "neardup-links")
    if more.head(1):
        labels = components(more.unionByName(labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))))

    ids = same.join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(ids, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    kept = link(docs, s).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
