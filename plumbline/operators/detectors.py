"""Structural detectors: does a table mean what its column names say? All candidates of a detector are judged in
one aggregation, or one per grouping column. Blanks are left out, never counted as 0."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact, plain_number
from .clean import by_column, cells, rows_where, text_columns

# Fixed values.
KEY_LEAST, KEY_SHARE = 10, 0.5
KEY_ENDINGS = ("_id", "_key", "_code", "_no", "_num", "_number", "_ref", "_serial")
KEY_NAMES = ("id", "key", "code", "identifier")
PURE, MINORITY_ROWS, MINORITY_SHARE = 0.999, 30, 0.02
FILLER_SHARE, GAP_POINTS, IMBALANCE = 0.05, 2.0, 0.25
OFF_BY, GAP_LEAST, GAP_MOST, PROBE_ROWS = 0.01, 0.02, 0.5, 25
UNITS = frozenset("hours hrs hour days day years year usd eur gbp aed kwh kw mwh pct percent rate ratio score index count num number total avg mean per c s mm bar kg km m min sec qty".split())
SEVERITY = ("high", "medium", "low")


@dataclass
class Finding:
    detector: str
    severity: str
    headline: str
    columns: list[str]
    numbers: dict[str, Any] = field(default_factory=dict)


@dataclass
class Shape:
    """What all detectors need to know of a table, from one aggregation."""

    df: DataFrame
    rows: int
    filled: dict[str, int]
    read: dict[str, int]
    distinct: dict[str, int]

    @classmethod
    def of(cls, df: DataFrame) -> Shape:
        cols = text_columns(df)
        found = cells(df.select(*[text(c).alias(c) for c in cols]), *cols)
        found = found.withColumns({"filled": F.trim("value") != "", "number": plain_number(F.col("value"))})
        rows = by_column(found, cols, F.sum("n").alias("n"), rows_where(F.col("filled")).alias("f"), rows_where(F.col("number").isNotNull()).alias("r"), F.count_if("filled").alias("d")).collect()  # a row per column
        pick = lambda k: {r["name"]: r[k] for r in sorted(rows, key=lambda r: cols.index(r["name"]))}
        return cls(df, max((r["n"] for r in rows), default=0), pick("f"), pick("r"), pick("d"))

    def numeric(self) -> list[str]:
        """Numbers in nine tenths of all rows, blanks included."""
        return [c for c, r in self.read.items() if self.rows and r >= 0.9 * self.rows]

    def categories(self, most: int = 40) -> list[str]:
        return [c for c, d in self.distinct.items() if 2 <= d + (self.filled[c] < self.rows) <= most]


def text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def filled(c: str) -> Column:
    return F.trim(text(c)) != ""


def number(c: str) -> Column:
    return plain_number(F.col(f"`{c}`").cast("string"))


def identity_collapse(s: Shape) -> list[Finding]:
    """A key column whose attributes vary inside every one of its values."""
    out = []
    numeric = set(s.numeric())
    for key in s.distinct:
        low = key.lower()
        if not (low.endswith(KEY_ENDINGS) or low in KEY_NAMES) or not KEY_LEAST <= s.distinct[key] <= s.rows * KEY_SHARE:
            continue
        attributes = [c for c, d in s.distinct.items() if c != key and c not in numeric and 2 <= d <= 40]
        if len(attributes) < 2:
            continue
        each = s.df.where(filled(key)).groupBy(text(key).alias("k")).agg(*[F.count_distinct(text(c)).alias(f"a{i}") for i, c in enumerate(attributes)])
        least = each.agg(*[F.min(f"a{i}").alias(f"a{i}") for i in range(len(attributes))]).first()
        mixed = [c for i, c in enumerate(attributes) if least[f"a{i}"] > 1]
        if len(mixed) >= 2:
            out.append(Finding("identity_collapse", "high", f"{key} does not identify one thing", [key, *mixed], {"keys": s.distinct[key], "rows": s.rows, "mixed": len(mixed)}))
    return out


def split_signs(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """column, split (equal for columns that are positive in the same rows), positive: order-free sums of row hashes."""
    above = [F.coalesce(number(c) > 0, F.lit(False)) for c in columns]
    marks = [F.sum(F.when(a, F.xxhash64(order)).otherwise(F.lit(0).cast("long")).cast("decimal(38,0)")).alias(f"h{i}") for i, a in enumerate(above)]
    wide = df.agg(*marks, *[F.count_if(a).alias(f"n{i}") for i, a in enumerate(above)])
    rows = [F.struct(F.lit(c).alias("column"), F.concat_ws(":", F.col(f"h{i}").cast("string"), F.col(f"n{i}").cast("string")).alias("split"), F.col(f"n{i}").alias("positive")) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def purity(df: DataFrame, predictor: str, outcome: Column) -> DataFrame:
    """groups and pure_rows: rows of groups that are all but 0.1 % on one side."""
    each = df.groupBy(text(predictor).alias("g")).agg(F.count("*").alias("n"), F.count_if(outcome).alias("p"))
    one = (F.col("p") >= F.col("n") * PURE) | (F.col("p") <= F.col("n") * (1 - PURE))
    return each.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("pure_rows"))


def target_leakage(s: Shape, order: str) -> list[Finding]:
    """Columns that all record one split of the rows."""
    numeric = s.numeric()
    if not numeric:
        return []
    splits: dict[str, list] = {}
    for r in split_signs(s.df, order, numeric).collect():  # a row per column
        if 0 < r["positive"] < s.rows:
            splits.setdefault(r["split"], []).append(r)
    out = []
    floor = max(MINORITY_ROWS, s.rows * MINORITY_SHARE)
    for same in splits.values():
        positive, outcomes = same[0]["positive"], [r["column"] for r in same]
        if min(positive, s.rows - positive) < floor:
            continue
        outcome = F.coalesce(number(outcomes[0]) > 0, F.lit(False))
        found = []
        for p in s.categories():
            if p not in outcomes:
                row = purity(s.df, p, outcome).first()
                if row["groups"] >= 2 and row["pure_rows"] >= PURE * s.rows:
                    found.append((row["groups"], p))
        if found and len(outcomes) + len(found) >= 2:
            involved = [p for _, p in sorted(found)] + outcomes
            out.append(Finding("target_leakage", "high", f"{len(involved)} columns encode one split of the data", involved[:8], {"columns_involved": len(involved), "positive_rows": positive, "rows": s.rows, "explained_by": involved[0]}))
    return out


def group_rates(df: DataFrame, rate: str, by: str) -> DataFrame:
    """g, n, lo, hi, s of a rate by group, for rows that hold it."""
    x = number(rate)
    return df.where(x.isNotNull()).groupBy(text(by).alias("g")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(exact(x, 6)).cast("double").alias("s"))


def placeholder_gap(rates: DataFrame) -> DataFrame:
    """mean_all, mean_measured (per cent), gap, filler_rows, filler_groups, groups of one rate and grouping."""
    whole = F.sum("n").over(Window.partitionBy())  # one row per group, 12 at most
    filler = (F.col("lo") == F.col("hi")) & (F.col("n") >= FILLER_SHARE * F.col("all"))
    rows = rates.withColumn("all", whole).withColumn("filler", filler)
    kept = lambda c: F.sum(F.when(~F.col("filler"), F.col(c)))
    every, own = 100 * F.sum("s") / F.sum("n"), 100 * F.try_divide(kept("s"), kept("n").cast("double"))
    return rows.agg(F.round(every, 2).alias("mean_all"), F.round(own, 2).alias("mean_measured"), F.round(F.abs(every - own), 2).alias("gap"), F.coalesce(F.sum(F.when(F.col("filler"), F.col("n"))), F.lit(0)).alias("filler_rows"), F.count_if("filler").alias("filler_groups"), F.count("*").alias("groups"))


def placeholder_rates(s: Shape) -> list[Finding]:
    """A 0-to-1 rate that is one constant for a whole subgroup; the first grouping column that shows it."""
    numeric = s.numeric()
    if not numeric:
        return []
    row = s.df.agg(*[x for i, c in enumerate(numeric) for x in (F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"), F.count_distinct(number(c)).alias(f"d{i}"))]).first()
    rates = [c for i, c in enumerate(numeric) if row[f"lo{i}"] >= 0 and row[f"hi{i}"] <= 1 and row[f"d{i}"] > 2]
    out = []
    for rate in rates:
        for by in s.categories(12):
            if by == rate:
                continue
            g = placeholder_gap(group_rates(s.df, rate, by)).first()
            if g["filler_groups"] and g["filler_groups"] < g["groups"] and g["gap"] is not None and g["gap"] >= GAP_POINTS:
                out.append(Finding("placeholder_rates", "high", f"{rate} is a placeholder for part of the data", [rate, by], {"placeholder_rows": g["filler_rows"], "rows": s.rows, "mean_all_pct": g["mean_all"], "mean_measured_pct": g["mean_measured"], "gap_points": g["gap"]}))
                break
    return out


def scale_mislabelled(s: Shape) -> list[Finding]:
    """A per-cent name over values from 0 to 1."""
    named = [c for c in s.read if (c.lower().endswith("_pct") or "percent" in c.lower()) and s.read[c]]
    if not named:
        return []
    row = s.df.agg(*[x for i, c in enumerate(named) for x in (F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"))]).first()
    return [Finding("scale_mislabelled", "medium", f"{c} is a 0 to 1 fraction, not a percentage", [c], {"min": round(row[f"lo{i}"], 4), "max": round(row[f"hi{i}"], 4)}) for i, c in enumerate(named) if row[f"lo{i}"] >= 0 and row[f"hi{i}"] <= 1]


def subject(name: str) -> set[str]:
    """A name's words without units: what it is about."""
    return set(name.lower().replace("-", "_").split("_")) - UNITS - {""}


def trios_of(s: Shape) -> list[tuple[str, str, str]]:
    """(total, part, part) whose names share a subject: up to half the cube of the columns."""
    numeric, out = s.numeric(), []
    for t in numeric:
        parts = [c for c in numeric if c != t and subject(t) & subject(c)]
        out += [(t, a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    return out


def broken_identity(s: Shape, order: str | None = None, at_once: int = 60) -> list[Finding]:
    """A total that is not the sum of the two parts its name suggests: ``at_once`` candidates in one aggregation."""
    trios = trios_of(s)
    for k in range(0, len(trios), at_once):
        if found := _broken(s, trios[k : k + at_once]):
            return found
    return []


def _broken(s: Shape, trios: list[tuple[str, str, str]]) -> list[Finding]:
    # Each column is parsed once; the candidates read numbers.
    at = {c: f"_{i}" for i, c in enumerate(dict.fromkeys(c for trio in trios for c in trio))}
    parsed = s.df.select(*[number(c).alias(n) for c, n in at.items()])
    aggs = []
    for i, (t, a, b) in enumerate(trios):
        whole, parts = F.col(at[t]), F.col(at[a]) + F.col(at[b])
        gap = whole - parts
        has = gap.isNotNull()
        aggs += [F.count_if(has).alias(f"n{i}"), F.count_if(has & (F.abs(gap) > OFF_BY)).alias(f"o{i}"), F.sum(exact(gap)).cast("double").alias(f"g{i}"), F.sum(F.when(has, exact(whole))).cast("double").alias(f"t{i}"), F.sum(F.when(has, exact(parts))).cast("double").alias(f"p{i}")]
    row = parsed.agg(*aggs).first()
    for i, (t, a, b) in enumerate(trios):
        n, off, whole, parts = row[f"n{i}"], row[f"o{i}"], row[f"t{i}"], row[f"p{i}"]
        if n and off == n and whole > 0 and parts <= whole and GAP_LEAST <= (whole - parts) / whole <= GAP_MOST:
            return [Finding("broken_identity", "medium", f"{t} is not {a} plus {b}", [t, a, b], {"rows_off": off, "residual_total": round(row[f"g{i}"], 2), "share_of_total": round((whole - parts) / whole, 4)})]
    return []


def period_counts(df: DataFrame, column: str) -> DataFrame:
    """period (year) and n of a date column."""
    year = F.regexp_extract(text(column), r"(\d{4})", 1)
    return df.where(year != "").groupBy(year.alias("period")).agg(F.count("*").alias("n"))


def uneven_periods(s: Shape, date_column: str | None = None) -> list[Finding]:
    out = []
    for c in [date_column] if date_column else [c for c in s.read if "date" in c.lower() or "period" in c.lower()]:
        k, lo, hi = period_counts(s.df, c).agg(F.count("*"), F.min("n"), F.max("n")).first()
        if k >= 2 and (hi - lo) / hi >= IMBALANCE:
            out.append(Finding("uneven_periods", "medium", f"Periods in {c} hold unequal numbers of records", [c], {"periods": k, "imbalance": round((hi - lo) / hi, 4), "smallest": lo, "largest": hi}))
    return out


#: What a detector may cost: candidates it judges, each an expression of an aggregation or an aggregation of its own.
MOST_CANDIDATES = 1200


def candidates(s: Shape) -> dict[str, int]:
    """How many candidates each detector whose work grows faster than the columns would judge."""
    keys = [k for k in s.distinct if k.lower().endswith(KEY_ENDINGS) or k.lower() in KEY_NAMES]
    numeric, groups = s.numeric(), s.categories()
    return {"identity_collapse": len(keys) * len(groups), "target_leakage": len(groups) * min(2, len(numeric)), "placeholder_rates": len(numeric) * len(s.categories(12)), "broken_identity": len(trios_of(s))}


def skipped(s: Shape, most: int = MOST_CANDIDATES, most_cells: int | None = None) -> list[Finding]:
    """The detectors that a table is too wide for (or that ``most_cells``, rows times columns, bars), each told by name."""
    cells_in = s.rows * len(s.read)
    barred = most_cells is not None and cells_in > most_cells
    return [
        Finding("skipped", "low", f"{name} was not run: " + (f"{cells_in} cells, {most_cells} at most" if barred else f"{n} candidates, {most} at most"), [], {"detector": name, "candidates": n, "cells": cells_in})
        for name, n in candidates(s).items()
        if n > most or (barred and n)
    ]


def run_all(df: DataFrame, order: str, date_column: str | None = None, skip: tuple[str, ...] = (), most: int = MOST_CANDIDATES, most_cells: int | None = None) -> list[Finding]:
    """All findings, the severest first; ``skip`` names detectors that are not to run. Detectors beyond the budget are not
    run either, and a finding names each."""
    s = Shape.of(df)
    dropped = [f for f in skipped(s, most, most_cells) if f.numbers["detector"] not in skip]
    skip = (*skip, *[f.numbers["detector"] for f in dropped])
    runs = {"identity_collapse": lambda: identity_collapse(s), "target_leakage": lambda: target_leakage(s, order), "placeholder_rates": lambda: placeholder_rates(s), "scale_mislabelled": lambda: scale_mislabelled(s), "broken_identity": lambda: broken_identity(s, order), "uneven_periods": lambda: uneven_periods(s, date_column)}
    found = [f for name, run in runs.items() if name not in skip for f in run()]
    return sorted([*found, *dropped], key=lambda f: SEVERITY.index(f.severity))
