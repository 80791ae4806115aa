"""Token ids in a compact binary format.

Ids are replaced by their frequency rank, so common ids are small numbers, and ranks are written in a byte-aligned
code: two control bits a value tell its 1 to 4 bytes, control bytes and data bytes stand in separate streams, and
a reader finds all offsets with a 256-row table and numpy, without a loop over values.

The file format is a folder: ``blocks`` holds Parquet rows of one block each (part, block, doc_ids, n_tokens,
control, data), ascending by doc_id over (part, block); ``ranks`` holds the id of each rank. Parquet carries the
streams, so any storage Spark can write will do and lost tasks leave nothing behind.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_id are
ordered by their ids' hash; repeated rows are all written; ids are integers, others are refused before a job runs; very
long texts are encoded whole; an empty table gives no blocks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_id, materialize, new_path, pieces

#: Texts of these characters alone may be split here: their lower case and token borders are plain.
_PLAIN = re.compile(r"[\t-\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]*")
_BORDERS = re.compile(r"[a-zß-öø-ÿ]+|\d|[^\s\da-zß-öø-ÿ]+")
_SPACES = re.compile(r"[ \n\t\r]+")
# The rules of a tokenizer file under which the splitting here holds. Other files are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
CACHE = 400_000


class Known(dict):
    """Ids by word; a new word is encoded on the way, and a full cache starts anew."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


class WordTokenizer:
    """The library's ids of whole texts, each distinct word encoded once while it stays in the cache.

    Where the file's rules are those named above, white space is dropped and nothing joins across it, so a text's ids
    are those of its parts in order. A file with other rules is used on whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        #: Whether a text's ids are those of its words, and whether plain words may be split here.
        self.splits = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None
        #: Strings that the tokenizer reads as one id wherever they stand.
        self.marks = sorted({x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())})
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)])
        bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        model = self.tokenizer.model
        self.words = Known(lambda w: self.pack([t.id for t in model.tokenize(w.translate(bytes_of))]), CACHE)
        self.parts = Known(lambda w: self.pack(self.tokenizer.encode(w, add_special_tokens=False).ids), CACHE // 4)

    def pack(self, ids) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian numbers of ``width`` bytes."""
        if not text:
            return b""
        low = text.lower()
        if not self.splits or any(mark in low for mark in self.marks):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _BORDERS.findall(low)))
        return b"".join(map(self.parts.__getitem__, _SPACES.split(text)))


@functools.cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker process, which Spark gives task after task: its cache of words stays warm."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, width and ids (bytes) of every document, the end id appended."""
    integer_id(docs, key)
    schema = docs.select(F.col(key).alias("doc_id")).schema.add("n_tokens", T.LongType()).add("width", T.IntegerType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(tokenizer)
        end = coder.pack([end_id])
        for batch in pieces(batches, "_text", 8 << 20):
            ids = [coder.encode(x.as_py()) + end for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // coder.width for x in ids], pa.int64()), pa.array([coder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def rank_order(tokens: DataFrame) -> np.ndarray:
    """The ids by falling frequency, ties by id: at most one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column("width"), batch.column("ids"), strict=True):
                found = np.bincount(np.frombuffer(ids.as_py(), dtype=f"<u{width.as_py()}"))
                if len(found) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(found) - len(counts), np.int64)])
                counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    counted = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return rows["id"].to_numpy(dtype="<u4")


#: Bytes of the four values of each control byte, and their starts within the group.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2**32; the last group is filled with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    v[: len(values)] = values
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = (size.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    used = np.arange(4) <= size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers, by table lookup of all lengths at once."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        out |= np.where(size > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out[:n]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block_tokens: int = 1 << 18) -> str:
    """Tokenize ``docs`` and write the format under ``path``."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    order = rank_order(tokens)
    spark.createDataFrame([(bytearray(order.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(int(order.max(initial=0)) + 1, dtype="<u4")
    ranks[order] = np.arange(len(order), dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, filled = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            control, data = encode_values(ranks[np.concatenate(held)])
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "doc_ids", "n_tokens", "control", "data"])

        for batch in batches:
            for doc, n, width, raw in zip(*batch.columns, strict=True):
                ids.append(doc.as_py())
                sizes.append(n.as_py())
                held.append(np.frombuffer(raw.as_py(), dtype=f"<u{width.as_py()}"))
                filled += sizes[-1]
                if filled >= block_tokens:
                    yield flush()
                    ids, sizes, held, block, filled = [], [], [], block + 1, 0
        if ids:
            yield flush()

    ordered = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    blocks = ordered.select("doc_id", "n_tokens", "width", "ids").mapInArrow(run, "part int, block int, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, block, at (place in the block), start, n_tokens, ids (bytes, 32-bit little endian)."""
    return _decoded(spark, path, ids=True)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return _decoded(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, ids: bool) -> DataFrame:
    order = np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first()["ids"]), dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "doc_id long, part int, block int, at int, before long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, docs, sizes, control, data in zip(*batch.columns, strict=True):
                n = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                flat = order[decode_values(control.as_py(), data.as_py(), int(ends[-1]))]
                each = [flat[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)]
                k = len(n)
                cols = [docs.values, pa.array([part.as_py()] * k, pa.int32()), pa.array([block.as_py()] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(each, pa.binary())] if ids else [])], names=["doc_id", "part", "block", "at", "before", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    columns = ["part", "block", "doc_ids", "n_tokens", "control", "data"]
    decoded = blocks.select(*columns).mapInArrow(run, schema)
    totals = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = totals.groupBy("part").agg(F.sum("n").alias("part_n"))
    parts = parts.select("part", (F.sum("part_n").over(upto.orderBy("part")) - F.col("part_n")).alias("part_start"))
    starts = totals.select("part", "block", (F.sum("n").over(upto.partitionBy("part").orderBy("block")) - F.col("n")).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    return decoded.join(starts, ["part", "block"]).withColumn("start", F.col("block_start") + F.col("before")).drop("block_start", "before")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    return digest(spark, write(docs, tokenizer, new_path(spark, "token-files"), end_id))
