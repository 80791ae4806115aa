"""Two states of a table compared: rows added, removed and changed in number; keys on either side, with totals of both.

Whole rows are compared as a multiset. A first pass shuffles only two hashes a row, added up with signs before they move;
rows whose hashes cancel are equal in number on both sides. What is left is fetched by its hashes and counted again on the
rows themselves, so that the answer is exact for rows; a change hidden by the hashes needs two different rows to agree in 128
bits.

Defined cases: nulls equal nulls; repeated rows count as often as they stand; a column missing on one side is null there;
empty tables are sides without rows. Column names are the caller's; the results' own names must not be among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = ["n_before", "n_after", "change"]


def _comparable(df: DataFrame, name: str) -> Column:
    """The column, or a form of it with an equality: maps as sorted entries, variants as their text."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    return F.to_json(c) if "variant" in kind.simpleString() else c


def _hashes(df: DataFrame) -> list[Column]:
    """Two hashes of a row; where nulls stand counts, as Spark's hash passes over them."""
    cells = [_comparable(df, c) for c in df.columns]
    holes = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns])
    return [F.xxhash64(*cells, holes).alias("_h1"), F.xxhash64(holes, F.lit(7), *reversed(cells)).alias("_h2")]


def _free(df: DataFrame, names: list[str]) -> None:
    if taken := [n for n in names if n in df.columns]:
        raise ValueError(f"{', '.join(taken)}: the tables have columns of these names")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each different row that stands more often on one side: its columns, n_before, n_after and change (added, removed,
    more or fewer)."""
    names = [*after.columns, *[c for c in before.columns if c not in after.columns]]
    _free(after.unionByName(before, allowMissingColumns=True), [*RESULT, "_h1", "_h2", "_side"])
    sides = [df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in names]) for df in (before, after)]
    both = sides[0].withColumn("_side", F.lit(-1)).unionByName(sides[1].withColumn("_side", F.lit(1)))
    hashed = both.select("*", *_hashes(both.drop("_side")))
    apart = hashed.groupBy("_h1", "_h2").agg(F.sum("_side").alias("n")).where("n <> 0").select("_h1", "_h2")
    left = hashed.join(apart, ["_h1", "_h2"], "left_semi")
    unlike = [c for c in names if isinstance(both.schema[c].dataType, T.MapType) or "variant" in both.schema[c].dataType.simpleString()]
    keys = [_comparable(both, c).alias(f"_c{i}") for i, c in enumerate(names)]
    count = lambda side: F.count_if(F.col("_side") == side)
    counted = left.groupBy(*keys).agg(count(-1).alias("n_before"), count(1).alias("n_after"), *[F.any_value(F.col(f"`{c}`")).alias(f"_own{names.index(c)}") for c in unlike])
    change = F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").when(F.col("n_after") > F.col("n_before"), "more").otherwise("fewer")
    shown = [F.col(f"_own{i}" if c in unlike else f"_c{i}").alias(c) for i, c in enumerate(names)]
    return counted.where("n_before <> n_after").select(*shown, "n_before", "n_after", change.alias("change"))


def applied(before: DataFrame, changed: DataFrame) -> DataFrame:
    """``before`` with ``changes`` made: the rows of the later state. Rows told to go are counted off by their hashes."""
    names = [c for c in changed.columns if c not in RESULT]
    rows = before.select(*[F.col(f"`{c}`") for c in names])
    more = changed.where("n_after > n_before").select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("n_after") - F.col("n_before"))).alias("_i")).drop("_i")
    gone = changed.where("n_after < n_before").select(*_hashes(changed.drop(*RESULT)), "n_after")
    kept = rows.select("*", *_hashes(rows)).join(gone.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti").drop("_h1", "_h2")
    fewer = changed.where("n_after < n_before and n_after > 0").select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("n_after"))).alias("_i")).drop("_i")
    return reduce(DataFrame.unionByName, [kept, more, fewer])


def summary(changed: DataFrame) -> DataFrame:
    """One row a kind of change: different rows, and rows on each side."""
    return changed.groupBy("change").agg(F.count("*").alias("different"), F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], totals: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a key of either side: its columns (named as on the left), rows and totals on both sides, the difference of
    each total, and ``side``: left, right or both. Null keys of both sides are one key.

    Either side is added up by key before the sides meet, so repeated keys multiply nothing and a hot key is one row."""
    totals = totals or []
    names = [a for a, _ in keys]
    exact = lambda c: F.sum(F.col(f"`{c}`").cast("decimal(28,4)"))

    def side(df: DataFrame, cols: list[str], sums: list[str], tag: str) -> DataFrame:
        by = [F.col(f"`{c}`").alias(f"_k{i}{tag}") for i, c in enumerate(cols)]
        return df.groupBy(*by).agg(F.count("*").alias(f"n_{tag}"), *[exact(c).alias(f"_s{i}{tag}") for i, c in enumerate(sums)])

    a = side(left, names, [x for x, _ in totals], "left")
    b = side(right, [k for _, k in keys], [y for _, y in totals], "right")
    met = reduce(lambda x, y: x & y, [a[f"_k{i}left"].eqNullSafe(b[f"_k{i}right"]) for i in range(len(keys))])
    where = F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").otherwise("both")
    # A null key is known by the side that has rows, not by its value.
    own = [F.when(F.col("n_left").isNotNull(), F.col(f"_k{i}left")).otherwise(F.col(f"_k{i}right")).alias(n) for i, n in enumerate(names)]
    sums = []
    for i, (x, _) in enumerate(totals):
        p, q = (F.coalesce(f"_s{i}{t}", F.lit(0).cast("decimal(28,4)")) for t in ("left", "right"))
        sums += [p.cast("double").alias(f"{x}_left"), q.cast("double").alias(f"{x}_right"), (p - q).cast("double").alias(f"{x}_apart")]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, met, "full").select(*own, where.alias("side"), zero("n_left"), zero("n_right"), *sums)


def accounts(reconciled: DataFrame) -> DataFrame:
    """One row a side: keys, rows of the left and of the right, and the totals."""
    totals = [c for c in reconciled.columns if c.endswith(("_left", "_right", "_apart")) and not c.startswith("n_")]
    exact = lambda c: F.sum(F.col(f"`{c}`").cast("decimal(28,4)")).cast("double").alias(c)
    return reconciled.groupBy("side").agg(F.count("*").alias("keys"), F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), *[exact(c) for c in totals])
