"""Sharding by extendible hashing, with DataFrame functions only.

A document's bucket is a prefix of the bits of its hash. A directory of buckets starts at the bits the total
asks for and only a bucket over its byte limit splits on another bit, until every shard fits. Bytes are summed
by prefix once at a fine depth; every coarser prefix is a sum of those, so all splits of ``step`` bits are
decided in one aggregation, and only cells still over the limit go round again with the following bits.

Defined cases: a null text has 0 bytes; a null doc_id hashes as an empty string; rows that share their doc_id are
told apart by a hash of their other columns, and rows that are equal in all by a row number of the scan, so only
those depend on the files' layout; one document above the limit is a shard of its own, marked ``oversized``. An empty
table has no shards. Extra columns pass through whatever their names, and result columns replace columns of their name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_60, materialize, packed, unpacked

RESULT = ["n_bytes", "shard", "depth", "shard_bytes", "oversized"]
BITS = 60
#: The hashes whose bits are used in turn: of the key, of the whole row, of the row's place.
HASHES = ("_h1", "_h2", "_h3")


def prefix(h: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a 60-bit hash as a number."""
    return F.floor(h / F.pow(F.lit(2.0), F.lit(float(BITS)) - depth)) if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def directory(cells: DataFrame, fine: int, known: int, limit: int) -> DataFrame:
    """(path, cell, bytes, n) at ``fine`` bits, all in buckets of ``known`` bits over the limit -> with depth,
    shard_bytes, shard_n: the shallowest prefix within the limit (null where even ``fine`` bits are too few)."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(known), F.lit(fine)))).withColumn("bucket", F.expr(f"shiftright(cell, {fine} - depth)"))
    sums = levels.groupBy("path", "depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_n"))
    # A prefix's sum never grows with depth, so the shallowest that fits has only ancestors that do not.
    fit = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_n") == 1))
    parent = sums.where((F.col("shard_bytes") > limit) & (F.col("shard_n") > 1)).select("path", (F.col("depth") + 1).alias("depth"), F.col("bucket").alias("up"))
    split = fit.where(F.col("depth") > known).withColumn("up", F.shiftright("bucket", 1)).join(parent, ["path", "depth", "up"], "left_semi")
    roots = fit.where(F.col("depth") == known).withColumn("up", F.shiftright("bucket", 1))
    return split.unionByName(roots).select("path", "depth", "bucket", "shard_bytes", "shard_n")


def assign(docs: DataFrame, limit: int = 8 << 20, text: str = "text", key: str = "doc_id", step: int = 6) -> DataFrame:
    """``docs`` with n_bytes, shard (its bits as a string of 0 and 1), depth, shard_bytes and oversized."""
    plain = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    size = F.coalesce(F.octet_length(docs[f"`{text}`"]), F.lit(0)).cast("long")
    hashes = [hash_60(docs[f"`{key}`"]), hash_60(F.xxhash64(*plain)), hash_60(F.lit("row"), F.monotonically_increasing_id())]
    rows, own = packed(docs, size.alias("n_bytes"), *[h.alias(n) for h, n in zip(hashes, HASHES, strict=True)], without=RESULT)
    cells = lambda fine, h: F.shiftright(h, BITS - fine)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    fine = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)

    # The first pass decides nearly every bucket from sums at one depth.
    summed = materialize(rows.groupBy(cells(fine, F.col("_h1")).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")).withColumn("path", F.lit("")), "shard-cells")
    leaves = leaf_cells(summed, directory(summed, fine, 0, limit), fine)
    open_cells = leaves.where(F.col("shard").isNull())
    placed = rows.withColumn("_cell", cells(fine, F.col("_h1"))).join(leaves.select(F.col("cell").alias("_cell"), "shard", "depth", "shard_bytes", "shard_n"), "_cell")
    if not open_cells.head(1):
        return finish(placed, own, limit)

    done = [placed.where(F.col("shard").isNotNull())]
    left = materialize(placed.where(F.col("shard").isNull()).drop("shard", "depth", "shard_bytes", "shard_n", "_cell"), "shard-rest")
    # The rest has too many bytes in a fine cell: further bits of the key's hash, then of the other hashes.
    at, used = fine, 0
    while True:
        if at == BITS:
            at, used = 0, used + 1
        h = HASHES[used]
        know, at = at, min(BITS, at + step)
        # What is fixed already: the bits of the round before, as text, and within them the new bits.
        path = F.lpad(F.bin(cells(know, F.col(h))), know, "0") if know else F.lit("")
        path = F.concat(*[F.lpad(F.bin(x), BITS, "0") for x in HASHES[:used]], path)
        new = F.shiftright(h, BITS - at).bitwiseAND((1 << (at - know)) - 1)
        left = left.withColumns({"_path": path, "_cell": new})
        summed = materialize(left.groupBy(F.col("_path").alias("path"), F.col("_cell").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        leaves = leaf_cells(summed, directory(summed, at - know, 0, limit), at - know)
        leaves = leaves.select(F.col("path").alias("_path"), F.col("cell").alias("_cell"), "shard", (F.col("depth") + F.length("path")).alias("depth"), "shard_bytes", "shard_n")
        placed = left.join(leaves, ["_path", "_cell"])
        last = h == HASHES[-1] and at == BITS
        done.append(placed if last else placed.where(F.col("shard").isNotNull()))
        if last or not leaves.where(F.col("shard").isNull()).head(1):
            break
        left = materialize(placed.where(F.col("shard").isNull()).drop("shard", "depth", "shard_bytes", "shard_n", "_cell", "_path"), "shard-rest")
    out = finish(done[0], own, limit)
    for part in done[1:]:
        out = out.unionByName(finish(part, own, limit))
    return out


def leaf_cells(cells: DataFrame, buckets: DataFrame, fine: int) -> DataFrame:
    """Each fine cell with the bucket that holds it; null columns where no prefix fits."""
    # Each bucket lists its own cells, which no other bucket has: the join has no hot key at any depth.
    first, after = F.expr(f"shiftleft(bucket, {fine} - depth)"), F.expr(f"shiftleft(bucket + 1, {fine} - depth)")
    bits = F.when(F.col("depth") == 0, F.col("path")).otherwise(F.concat("path", F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0"))))
    found = buckets.select("path", F.explode(F.sequence(first, after - 1)).alias("cell"), bits.alias("shard"), "depth", "shard_bytes", "shard_n")
    return cells.select("path", "cell").join(found, ["path", "cell"], "left")


def finish(placed: DataFrame, own: list[str], limit: int) -> DataFrame:
    return placed.select(*unpacked(own), "n_bytes", F.col("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in one task, whose bytes the limit bounds."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """The same shards in DuckDB's SQL: prefixes to 32 bits, enough while a cell of so many bits holds one document."""
    return f"""
WITH base AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT >> 28 AS h FROM documents),
levels AS (SELECT d::INT AS depth, h >> (32 - d) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM base, range(0, 33) t(d) GROUP BY 1, 2),
fits AS (SELECT * FROM levels WHERE shard_bytes <= {limit} OR n = 1),
found AS (SELECT b.doc_id, b.n_bytes, b.h, f.depth, f.shard_bytes, row_number() OVER (PARTITION BY b.doc_id ORDER BY f.depth) AS nth
  FROM base b, fits f WHERE f.bucket = b.h >> (32 - f.depth))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 32, '0'), 1, depth) END AS shard, depth, shard_bytes, shard_bytes > {limit} AS oversized
FROM found WHERE nth = 1
"""
