"""Sketches kept as tables: distinct counts and quantiles of data that grows, without reading it again.

A sketch's state is rows that add up: registers of leading zeros, of which the greater counts (HyperLogLog), and counts of
buckets whose bounds grow by a constant factor. Both are ordinary aggregations with partial results, so no group, however
hot, is gathered; a state has at most 2**bits, or a few thousand, rows a group. Merging the states of any split of the rows
gives the state of all of them, to the row, so a refresh reads new rows only.

Errors: a distinct count's standard error is 1.04 / 2**(bits / 2), 2.3 % by default; a quantile's value is within
``accuracy`` (1 %) of the value at that rank. Defined cases: nulls and NaN are left out; zero and negative values have
buckets of their own; a group without values has no state; an empty table has an empty one.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS, ACCURACY = 11, 0.01


def distinct_state(df: DataFrame, by: list[str], column: str, bits: int = BITS) -> DataFrame:
    """by, register, zeros: the greatest run of leading zeros (plus one) among the hashes of each register."""
    word = F.conv(F.substring(F.md5(F.col(f"`{column}`").cast("string")), 1, 15), 16, 10).cast("long")  # 60 bits
    width = 60 - bits
    rest = F.col("_h").bitwiseAND(F.lit((1 << width) - 1))
    zeros = F.when(rest == 0, width + 1).otherwise(width + 1 - F.length(F.bin(rest)))
    rows = df.where(F.col(f"`{column}`").isNotNull()).select(*[F.col(f"`{c}`") for c in by], word.alias("_h"))
    return rows.groupBy(*by, F.shiftright("_h", width).cast("int").alias("register")).agg(F.max(zeros).alias("zeros"))


def merged_distinct(state: DataFrame, by: list[str]) -> DataFrame:
    return state.groupBy(*by, "register").agg(F.max("zeros").alias("zeros"))


def distinct_count(state: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """by, distinct: the estimate; few values are counted by their empty registers."""
    m = 1 << bits
    filled, parts = F.count("*"), F.sum(F.pow(F.lit(2.0), -F.col("zeros")))
    sums = state.groupBy(*by).agg(filled.alias("_n"), parts.alias("_sum"))
    empty = F.lit(m) - F.col("_n")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("_sum") + empty)
    few = F.lit(float(m)) * F.ln(F.lit(float(m)) / empty)
    return sums.select(*[F.col(f"`{c}`") for c in by], F.round(F.when((raw <= 2.5 * m) & (empty > 0), few).otherwise(raw)).cast("long").alias("distinct"))


def quantile_state(df: DataFrame, by: list[str], column: str, accuracy: float = ACCURACY) -> DataFrame:
    """by, sign, bucket, n: how many values lie between two powers of (1 + accuracy) / (1 - accuracy)."""
    x, step = F.col(f"`{column}`").cast("double"), math.log((1 + accuracy) / (1 - accuracy))
    bucket = F.when(x == 0, 0).otherwise(F.ceil(F.ln(F.abs(x)) / F.lit(step))).cast("int")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.groupBy(*by, F.signum(x).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged_quantiles(state: DataFrame, by: list[str]) -> DataFrame:
    return state.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(state: DataFrame, by: list[str], shares: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """by, n and q0, q1, ...: the value at each share of the ranks. A window holds one group's buckets, a few thousand."""
    growth = (1 + accuracy) / (1 - accuracy)
    order = Window.partitionBy(*by).orderBy(F.col("sign"), F.col("sign") * F.col("bucket"))
    upto = state.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    value = F.col("sign") * F.lit(2.0) * F.pow(F.lit(growth), F.col("bucket")) / F.lit(growth + 1)
    at = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), value))
    return upto.groupBy(*by).agg(F.max("_all").alias("n"), *[at(q).alias(f"q{i}") for i, q in enumerate(shares)])


class Stored:
    """The states of a growing table in a folder of their own: each refresh writes a generation and reads the last one."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], distinct: list[str], quantile: list[str]):
        self.spark, self.root, self.by, self.distinct, self.quantile = spark, root.rstrip("/"), by, distinct, quantile
        self.current: str | None = None

    def refresh(self, rows: DataFrame) -> None:
        """Take in new rows. A refresh that fails leaves the last generation as it was."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        for column in self.distinct:
            state = self._with_last(distinct_state(rows, self.by, column), f"distinct-{column}")
            merged_distinct(state, self.by).write.parquet(f"{path}/distinct-{column}")
        for column in self.quantile:
            state = self._with_last(quantile_state(rows, self.by, column), f"quantile-{column}")
            merged_quantiles(state, self.by).write.parquet(f"{path}/quantile-{column}")
        self.current = path

    def _with_last(self, state: DataFrame, name: str) -> DataFrame:
        return state.unionByName(self.state(name, state)) if self.current else state

    def state(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.schema(like.schema) if like is not None else self.spark.read
        return reader.parquet(f"{self.current}/{name}")

    def distinct_counts(self, column: str) -> DataFrame:
        return distinct_count(self.state(f"distinct-{column}"), self.by)

    def quantiles(self, column: str, shares: list[float]) -> DataFrame:
        return quantiles(self.state(f"quantile-{column}"), self.by, shares)

