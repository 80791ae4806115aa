"""Joins by time: the last row before each row, all rows within an interval, and frames by value range.

A hot key spreads over tasks. The as-of join sorts both sides together into ranges of (key, time); each range carries on
what the range before it ended with, so a key that fills many ranges is no task's burden. The interval join cuts time into
bins as wide as the interval, so that equality of (key, bin) finds every pair once; what a bin holds too much of is left to
the skew handling of Spark's joins.

Defined cases: a null key or time matches nothing; equal times match as-of unless ``strict``, the last by ``ties`` wins;
repeated rows each get their own match; empty sides give empty or unmatched results; columns of both sides may share names:
those of the right side are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .table import settled

EPOCH = "1970-01-01 00:00:00"


def instant(df: DataFrame, name: str) -> Column:
    """A time, a date or a number as a whole number of microseconds or a double, for arithmetic on either side."""
    kind, c = df.schema[name].dataType, f"`{name}`"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(df[c])
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), df[c])
    if isinstance(kind, T.DateType):
        return F.unix_date(df[c]).cast("long") * 86_400_000_000
    if isinstance(kind, T.IntegralType):
        return df[c].cast("long")
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(df[c].cast("double")), df[c].cast("double"))
    raise TypeError(f"{name} is {kind.simpleString()}; a time, a date or a number is needed")


def _same_kind(left: DataFrame, right: DataFrame, on: str, right_on: str) -> None:
    kinds = [df.schema[c].dataType for df, c in ((left, on), (right, right_on))]
    timed = [isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)) for k in kinds]
    if timed[0] != timed[1] or {type(k) for k in kinds} == {T.TimestampType, T.TimestampNTZType}:
        raise TypeError(f"{on} is {kinds[0].simpleString()} and {right_on} is {kinds[1].simpleString()}; they do not compare")


def _prefixed(left: DataFrame, right: DataFrame, prefix: str) -> list[str]:
    """Output names of the right side's columns."""
    taken, out = set(left.columns), []
    for c in right.columns:
        name, n = f"{prefix}{c}", 2
        while name in taken:
            name, n = f"{prefix}{c}_{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` once, dealt into ranges of ``order``, with its range in ``_part``; later parts hold later rows."""
    return settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def carried(firsts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """(_part, keys, _carry): what the first key of each range gets from the ranges before it.

    ``firsts`` has each range's first key, ``ends`` its last key with ``_value``, null where it brings none: one row a range
    each. A key goes on in a later range only as that range's first, having been the last of all between."""
    asked = firsts.select("_part", *keys, F.lit(0).alias("_brings"), F.lit(None).cast(ends.schema["_value"].dataType).alias("_value"))
    both = asked.unionByName(ends.select("_part", *keys, F.lit(1).alias("_brings"), "_value"))
    back = Window.partitionBy(*keys).orderBy("_part", "_brings").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_carry", F.last("_value", ignorenulls=True).over(back)).where("_brings = 0 and _carry is not null").select("_part", *keys, "_carry")


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    *,
    right_by: list[str] | None = None,
    right_on: str | None = None,
    ties: list[str] | None = None,
    strict: bool = False,
    forward: bool = False,
    tolerance: float | None = None,
    prefix: str = "last_",
) -> DataFrame:
    """Every row of ``left`` with the columns of the last row of ``right`` before it (at its time too unless ``strict``)
    that agrees in ``by``; with ``forward`` the next one after it. ``tolerance`` is the farthest match, in the unit of
    ``instant``. Of rows at one time the last by ``ties`` counts, else the one with the greatest hash."""
    right_by, right_on = right_by or by, right_on or on
    _same_kind(left, right, on, right_on)
    names = _prefixed(left, right, prefix)
    keys, sign = [f"_k{i}" for i in range(len(by))], -1 if forward else 1
    kinds = [left.schema[c].dataType for c in by]
    at_left, at_right = instant(left, on) * sign, instant(right, right_on) * sign
    # At one time what may match comes first: the right side, or the left one if only earlier rows count.
    own = F.struct(*[left[f"`{c}`"].alias(f"l{i}") for i, c in enumerate(left.columns)])
    other = F.struct(at_right.alias("at"), *[right[f"`{c}`"].alias(f"r{i}") for i, c in enumerate(right.columns)])
    tie = F.struct(*[right[f"`{c}`"] for c in ties or []], F.xxhash64(*[right[f"`{c}`"] for c in right.columns if not _unhashable(right.schema[c].dataType)]).alias("_h"))
    rank = F.when(F.lit(strict), 2).otherwise(0)
    a = left.select(*[left[f"`{c}`"].alias(k) for c, k in zip(by, keys, strict=True)], at_left.alias("_t"), F.lit(1).alias("_side"), own.alias("_own"))
    b = right.select(*[right[f"`{c}`"].try_cast(t).alias(k) for c, k, t in zip(right_by, keys, kinds, strict=True)], at_right.alias("_t"), rank.alias("_side"), tie.alias("_tie"), other.alias("_other"))
    known = F.lit(True)
    for c in (*keys, "_t"):
        known = known & F.col(c).isNotNull()
    none = a.where(~known).select("_own", F.lit(None).cast(b.schema["_other"].dataType).alias("_found"))
    both = a.where(known).unionByName(b.where(known), allowMissingColumns=True)
    order = [*keys, "_t", "_side", "_tie"]
    dealt = ranged(both, *[F.col(c) for c in order])
    within = Window.partitionBy("_part", *keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_keys = F.struct(*keys)
    by_key = dealt.groupBy("_part", *keys).agg(F.max_by("_other", F.when(F.col("_other").isNotNull(), F.struct("_t", "_tie"))).alias("_value"))
    edges = by_key.groupBy("_part").agg(F.min(own_keys).alias("_first"), F.max_by(F.struct(*keys, "_value"), own_keys).alias("_end"))
    edges = settled(edges)
    brought = carried(edges.select("_part", "_first.*"), edges.select("_part", "_end.*"), keys)
    found = dealt.withColumn("_found", F.last("_other", ignorenulls=True).over(within)).where("_side = 1")
    found = found.join(F.broadcast(brought), ["_part", *keys], "left").select("_own", F.coalesce("_found", "_carry").alias("_found"), F.col("_t"))
    if tolerance is not None:
        found = found.withColumn("_found", F.when(F.col("_t") - F.col("_found.at") <= tolerance, F.col("_found")))
    whole = found.select("_own", "_found").unionByName(none)
    return whole.select(*[F.col(f"_own.l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"_found.r{i}").alias(n) for i, n in enumerate(names)])


def _unhashable(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def interval_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    lower: float,
    upper: float,
    *,
    right_by: list[str] | None = None,
    right_on: str | None = None,
    how: str = "inner",
    prefix: str = "near_",
) -> DataFrame:
    """Every pair that agrees in ``by`` and whose right time less the left one is from ``lower`` to ``upper``, both
    included, in the unit of ``instant``. ``how``: inner; left, which keeps rows without a partner; semi and anti.

    A left row looks into the two bins at most that its interval meets; a right row stands in one bin, so no pair comes
    twice and equality of key and bin is what Spark joins on."""
    right_by, right_on = right_by or by, right_on or on
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError("how is inner, left, semi or anti")
    if not lower <= upper:
        raise ValueError("the interval ends before it begins")
    _same_kind(left, right, on, right_on)
    names, wide = _prefixed(left, right, prefix), max(upper - lower, 1)
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = [left.schema[c].dataType for c in by]
    rows = left.withColumn("_row", F.monotonically_increasing_id()) if how != "inner" else left.withColumn("_row", F.lit(None).cast("long"))
    if how != "inner":
        rows = settled(rows)  # a row keeps its number
    bin_of = lambda t: F.floor(t / F.lit(wide)).cast("long")
    t = instant(rows, on)
    own = F.struct(*[rows[f"`{c}`"].alias(f"l{i}") for i, c in enumerate(left.columns)])
    a = rows.select(*[rows[f"`{c}`"].alias(k) for c, k in zip(by, keys, strict=True)], t.alias("_t"), own.alias("_own"), "_row", F.explode(F.sequence(bin_of(t + F.lit(lower)), bin_of(t + F.lit(upper)))).alias("_bin"))
    u = instant(right, right_on)
    other = F.struct(*[right[f"`{c}`"].alias(f"r{i}") for i, c in enumerate(right.columns)])
    b = right.select(*[right[f"`{c}`"].try_cast(k_t).alias(k) for c, k, k_t in zip(right_by, keys, kinds, strict=True)], u.alias("_u"), bin_of(u).alias("_bin"), other.alias("_other"))
    pairs = a.join(b.where("_u is not null"), [*keys, "_bin"]).where((F.col("_u") - F.col("_t")).between(lower, upper))
    left_side = [F.col(f"_own.l{i}").alias(c) for i, c in enumerate(left.columns)]
    right_side = [F.col(f"_other.r{i}").alias(n) for i, n in enumerate(names)]
    if how == "inner":
        return pairs.select(*left_side, *right_side)
    hit = pairs.select("_row").distinct()
    if how == "semi":
        return rows.join(hit, "_row", "left_semi").drop("_row")
    alone = rows.join(hit, "_row", "left_anti").drop("_row")
    if how == "anti":
        return alone
    kinds_right = [right.schema[c].dataType for c in right.columns]
    return pairs.select(*left_side, *right_side).unionByName(alone.select(*[alone[f"`{c}`"] for c in left.columns], *[F.lit(None).cast(k).alias(n) for k, n in zip(kinds_right, names, strict=True)]))


def range_frames(df: DataFrame, by: list[str], on: str, back: float, aggregates: dict[str, Column], per_bin: int = 4) -> DataFrame:
    """``df`` with aggregates over the rows of equal ``by`` whose time is at most ``back`` (in the unit of ``instant``)
    earlier and not later: a frame by value, equal times included. A row without a time has no frame and gets nulls.

    Time is cut into bins of ``per_bin`` frames, and a bin is given the last frame of the one before it beside its own rows,
    so that a hot key spreads over its bins and at most one row in ``per_bin`` moves twice."""
    if back <= 0:
        raise ValueError("a frame reaches back by more than nothing")
    taken = [n for n in aggregates if n in df.columns]
    if taken:
        raise ValueError(f"{', '.join(taken)}: the table has columns of these names")
    wide, t = back * per_bin, instant(df, on)
    rows = df.select("*", t.alias("_t"), F.floor(t / F.lit(wide)).alias("_bin"))
    own = rows.where("_t is not null")
    # What lies within one frame of the next bin's start is seen from there too.
    seen = own.select("*", F.explode(F.sequence(F.col("_bin"), F.floor((F.col("_t") + F.lit(back)) / F.lit(wide)))).alias("_at"))
    frame = Window.partitionBy(*[F.col(f"`{c}`") for c in by], "_at").orderBy("_t").rangeBetween(-back, Window.currentRow)
    made = seen.withColumns({n: a.over(frame) for n, a in aggregates.items()}).where("_at = _bin").drop("_t", "_bin", "_at")
    return made.unionByName(rows.where("_t is null").drop("_t", "_bin"), allowMissingColumns=True)
