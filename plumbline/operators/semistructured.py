"""JSON text in a column: what paths it holds, and typed columns made of them.

Cells become variants once. The paths and their types come from one aggregation over all rows, how many rows hold each from
a second one. Defined cases: a null cell has no values; a malformed one neither, and is told apart by ``malformed``; a value
of another kind than its column is null there; lists and objects deeper than ``most_levels`` stay JSON text; a path that
holds different kinds of values is text; a name with both kinds of quotes in it can't be reached and is left out. A table without a path gets no columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths that become columns at most; more are refused, as each is an expression of every plan.
MOST_PATHS = 1000


def parsed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_json`` (variant) and ``_malformed``: a filled cell that is no JSON."""
    c = F.col(f"`{column}`")
    return df.withColumn("_json", F.try_parse_json(c)).withColumn("_malformed", c.isNotNull() & F.col("_json").isNull())


def _paths(kind: T.DataType, at: tuple[str, ...], most_levels: int) -> list[tuple[tuple[str, ...], str]]:
    if isinstance(kind, T.StructType) and len(at) < most_levels and kind.fields:
        return [found for f in kind.fields for found in _paths(f.dataType, (*at, f.name), most_levels)]
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return [(at, "bigint")]
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return [(at, "double")]
    return [(at, "boolean" if isinstance(kind, T.BooleanType) else "string")]


def _step(path: tuple[str, ...]) -> str:
    """A path as Spark reads it, whose names stand in either kind of quotes."""
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)


def _readable(path: tuple[str, ...]) -> bool:
    return not any("'" in p and '"' in p for p in path)


def _kinds(told: str) -> T.DataType:
    """The type that Spark tells of variants, as a type that it parses."""
    return T._parse_datatype_string(told.replace("OBJECT<", "STRUCT<"))


def discover(df: DataFrame, column: str, most_levels: int = 5) -> list[tuple[tuple[str, ...], str]]:
    """(path, type) of every value in the column's objects, from all rows."""
    told = parsed(df, column).agg(F.schema_of_variant_agg("_json")).first()[0]
    kind = _kinds(told) if told else T.NullType()
    found = [x for x in _paths(kind, (), most_levels) if _readable(x[0])] if isinstance(kind, T.StructType) else []
    if len(found) > MOST_PATHS:
        raise ValueError(f"{column} holds {len(found)} paths; {MOST_PATHS} at most become columns")
    return found


def value(path: tuple[str, ...], kind: str) -> Column:
    return F.try_variant_get("_json", _step(path), kind)


def paths(df: DataFrame, column: str, most_levels: int = 5) -> DataFrame:
    """path (dotted), type, rows that hold a value of it, and all rows: one row a path."""
    found = discover(df, column, most_levels)
    rows = parsed(df, column)
    counts = rows.agg(F.count("*").alias("records"), F.count_if("_malformed").alias("malformed"), *[F.count(value(p, k)).alias(f"n{i}") for i, (p, k) in enumerate(found)])
    each = [F.struct(F.lit(".".join(p)).alias("path"), F.lit(k).alias("type"), F.col(f"n{i}").alias("filled"), "records", "malformed") for i, (p, k) in enumerate(found)]
    none = F.array().cast("array<struct<path:string,type:string,filled:bigint,records:bigint,malformed:bigint>>")
    return counts.select(F.explode(F.array(*each) if each else none).alias("x")).select("x.*")


def typed(df: DataFrame, column: str, found: list[tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """``df`` with a typed column ``column.path`` for each path and ``column.malformed``; ``found`` fixes the paths, so that
    later data gets the same columns."""
    found = discover(df, column) if found is None else found
    names = [f"{column}.{'.'.join(p)}" for p, _ in found] + [f"{column}.malformed"]
    if taken := [n for i, n in enumerate(names) if n in df.columns or n in names[:i]]:
        raise ValueError(f"{', '.join(taken)}: the table has columns of these names")
    own = [value(p, k).alias(n) for (p, k), n in zip(found, names, strict=False)]
    return parsed(df, column).select(*[F.col(f"`{c}`") for c in df.columns], *own, F.col("_malformed").alias(names[-1]))
