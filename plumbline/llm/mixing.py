"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Within a source the expected copies are
prefix-summed in a stratified order (size class, then hash), one offset per source is added, and a document is
emitted once for each integer boundary its interval crosses. The running sum is the rate times the document's
rank, and ranks come from counts of (source, size class, hash bucket) cells, so no task holds a whole source. A cell
of more than ``most_in_cell`` rows is cut by further bits of the key's hash, then of the row's, then by the row's place.

Defined cases: a null text has size 0; null sources form one source, last in order; sources of size 0 have
target 0; a null doc_id hashes as an empty string; rows with one doc_id stand in the order of a hash of their columns,
so reruns take the same texts, and rows equal in all are told apart by their place. Extra columns pass through whatever
their names, and result columns replace columns of their name. A very long text is one document of its size; an empty
table gives an empty one. Ids may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_60, held, materialize, packed, unpacked, word_count

#: 2**BUCKET_BITS hash buckets in each size class of a source.
BUCKET_BITS = 12
RESULT = ["copies", "size", "source_size", "target", "taken"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, n, source_size) -> with weight and target: ``budget`` of all sizes shared by weight, none above
    ``most`` times its source, the excess shared anew. One row per source.

    A source at its cap has the least cap per weight; with k sources capped the others share by weight what is
    left, and the first k whose next source stays below its cap is the answer."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("cap_per_weight", F.col("source").isNull(), "source")
    everyone = Window.partitionBy()
    nth = (F.row_number().over(ordered) - 1) % len(weights)
    out = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("asked", F.sum("source_size").over(everyone) * F.lit(float(budget)))
        .withColumn("caps_before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("asked") - F.col("caps_before")) / F.col("weight_from"))
        .withColumn("fair", F.min(F.when(F.col("level") <= F.col("cap_per_weight"), F.struct("cap_per_weight", "level"))).over(everyone)["level"])
    )
    return out.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("fair"), F.lit(float("inf"))) * F.col("weight"))).select("source", "n", "source_size", "weight", "target")


def size_class(size: Column) -> Column:
    """Four classes for each doubling of the size."""
    return F.floor(F.log2(size.cast("double") + 1) * 4).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.0, most: float = 3.0, seed: int = 0, most_in_cell: int = 200_000) -> DataFrame:
    """``docs`` with copies, size, source_size, target and taken; documents with 0 copies are kept as rows.

    Needs doc_id, text and source. Columns of ``docs`` named as a result column are replaced.
    """
    plain = [docs[f"`{f.name}`"] for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    source = docs["source"].cast("string")
    base, own = packed(docs, source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_source"), word_count(docs["text"]).alias("size"), hash_60(F.lit(seed), docs["doc_id"]).alias("_h"), F.xxhash64(*plain).alias("_t"), without=RESULT)
    base = base.withColumns({"_class": size_class(F.col("size")), "_bucket": F.shiftright("_h", 60 - BUCKET_BITS).cast("int")})
    cells = materialize(base.groupBy("_source", "source", "_class", "_bucket").agg(F.count("*").alias("cell_n"), F.sum("size").alias("cell_size")), "mix-cells")

    classes = cells.groupBy("_source", "source", "_class").agg(F.sum("cell_n").alias("class_n"), F.sum("cell_size").alias("class_size"))
    targets = source_targets(classes.groupBy("_source", "source").agg(F.sum("class_n").alias("n"), F.sum("class_size").alias("source_size")).drop("_source"), weights, budget, most)
    targets = targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    targets = targets.withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
    targets = targets.withColumn("offset", hash_60(F.lit("offset"), F.lit(seed), F.col("_source")) / F.lit(float(1 << 60)))

    before = lambda n, w: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    class_start = classes.withColumn("class_start", before("class_n", Window.partitionBy("_source").orderBy("_class"))).select("_source", "_class", "class_start")
    starts = cells.withColumn("cell_start", before("cell_n", Window.partitionBy("_source", "_class").orderBy("_bucket"))).select("_source", "_class", "_bucket", "cell_n", "cell_start")
    starts = starts.join(class_start, ["_source", "_class"])
    starts = starts.select("_source", "_class", F.col("_bucket").cast("string").alias("_cell"), (F.col("class_start") + F.col("cell_start")).alias("start"), F.col("cell_n").alias("n"))
    base = base.withColumn("_cell", F.col("_bucket").cast("string"))
    if cells.where(F.col("cell_n") > most_in_cell).head(1):
        base, starts = cut_cells(base, starts, most_in_cell)
    starts = starts.join(targets.select("_source", "source_size", "target", "rate", "offset"), "_source").drop("n")

    in_cell = Window.partitionBy("_source", "_class", "_cell").orderBy("_h", "_t")
    ranked = base.withColumn("_nth", F.row_number().over(in_cell)).join(starts, ["_source", "_class", "_cell"])
    rank = F.col("start") + F.col("_nth")
    crossed = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    out = ranked.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*unpacked(own), *RESULT)


def cut_cells(base: DataFrame, starts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Cells of more than ``most`` rows cut along the order of their rows, twelve bits a round, until all are smaller or
    no bits are left. Each round counts the large cells alone."""
    base = materialize(base.withColumn("_m", F.monotonically_increasing_id()), "mix-rows")
    digit = lambda c, shift: F.shiftrightunsigned(c, shift).bitwiseAND(4095)
    h, t, m = F.col("_h"), F.col("_t").bitwiseXOR(F.lit(-(2**63))), F.col("_m")
    keys = ["_source", "_class", "_cell"]
    order = [*[digit(h, 60 - BUCKET_BITS - 12 * k) for k in (1, 2, 3, 4)], *[digit(t, s) for s in (52, 40, 28, 16, 4)], digit(m, 0)]
    for d in order:
        large = starts.where(F.col("n") > most).select(*keys, F.lit(True).alias("_large"))
        if not large.head(1):
            break
        base = base.join(large, keys, "left").withColumn("_digit", F.when(F.col("_large"), d))
        parts = base.where("_large").groupBy(*keys, "_digit").agg(F.count("*").alias("part_n"))
        before = F.sum("part_n").over(Window.partitionBy(*keys).orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("part_n")
        longer = F.concat_ws(".", "_cell", F.col("_digit").cast("string"))
        cut = parts.withColumn("part_start", before).join(starts, keys).select("_source", "_class", longer.alias("_cell"), (F.col("start") + F.col("part_start")).alias("start"), F.col("part_n").alias("n"))
        starts = materialize(starts.where(F.col("n") <= most).unionByName(cut), "mix-cells")
        base = base.withColumn("_cell", F.when(F.col("_large"), longer).otherwise(F.col("_cell"))).drop("_large", "_digit")
    return base, starts


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as many times as it is taken."""
    rows, own = packed(mixed.where("copies > 0"), mixed["copies"].cast("int").alias("copies"))
    copied = rows.select(*held(own), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copied.select(*[c for c, name in zip(unpacked(own), own, strict=True) if name in columns])


#: The same mix in DuckDB's SQL, for weights 5, 2, 1, all sizes and three times at most.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size::DOUBLE + 1) * 4), h, doc_id, size) AS rank FROM base),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM sized),
levels AS (SELECT *, cap / weight AS per,
    (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER w - cap)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, per) FROM levels WHERE level <= per) * weight) AS target,
    ('0x' || substr(md5('offset|0|' || coalesce('s' || source, 'n')), 1, 15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE AS u FROM levels),
taken AS (SELECT r.doc_id, r.size, t.source_size, t.target,
    (floor(rank * coalesce(target / nullif(source_size, 0)::DOUBLE, 0) + u) - floor((rank - 1) * coalesce(target / nullif(source_size, 0)::DOUBLE, 0) + u))::BIGINT AS copies
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
