"""Lookup joins that never change a total: keys of the lookup must be unique, unmatched rows are told."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from . import clean
from .table import ROW, AnalysisTable

MOST = {"joins": 4, "keys": 3, "columns": 500}


class JoinError(ValueError):
    """Joins that cannot run, with every reason."""

    def __init__(self, problems: list[str]):
        super().__init__("The datasets were not joined. " + " ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Join:
    """keys: (left column, right column) pairs; how: left or inner."""

    keys: tuple[tuple[str, str], ...]
    how: str = "left"
    alias: str | None = None
    name: str = ""


@dataclass
class Lookup:
    """A cleaned lookup: text and measures, with what cleaning dropped."""

    df: DataFrame
    numeric: frozenset[str]
    rows_before: int = 0
    empty: int = 0
    duplicates: int = 0


@dataclass
class Merged:
    table: AnalysisTable
    stats: list[dict[str, Any]] = field(default_factory=list)


def default_alias(name: str) -> str:
    """``Regional Targets.xlsx`` gives ``regional_targets``."""
    slug = re.sub("[^a-z0-9]+", "_", re.sub(r"\.[A-Za-z0-9]{1,5}$", "", name or "").lower()).strip("_")
    if not slug[:1].isalpha():
        slug = f"joined_{slug}".rstrip("_")
    return slug[:24].rstrip("_")


def assign_aliases(joins: list[Join]) -> list[str]:
    """A prefix for each join, made unique by _2, _3, ..."""
    out: list[str] = []
    for j in joins:
        base = alias = j.alias or default_alias(j.name)
        n = 2
        while alias in out:
            alias, n = f"{base[:21]}_{n}", n + 1
        out.append(alias)
    return out


def normalise(declared: list[dict[str, Any]]) -> list[Join]:
    """A declaration checked for shape only: all problems at once."""
    bad: list[str] = []
    if not declared:
        bad.append("Name at least one dataset to join.")
    if len(declared) > MOST["joins"]:
        bad.append(f"At most {MOST['joins']} datasets can be joined; {len(declared)} were named.")
    out = []
    for at, d in enumerate(declared[: MOST["joins"]], 1):
        keys = d.get("keys") or []
        if not 1 <= len(keys) <= MOST["keys"] or not all(k.get("left") and k.get("right") for k in keys):
            bad.append(f"Join {at} needs 1 to {MOST['keys']} pairs of columns.")
        elif len({k["left"] for k in keys}) < len(keys) or len({k["right"] for k in keys}) < len(keys):
            bad.append(f"Join {at} uses a column twice.")
        if d.get("how", "left") not in ("left", "inner"):
            bad.append(f"Join {at} is left or inner.")
        if d.get("alias") is not None and not re.fullmatch("[a-z][a-z0-9_]{0,23}", str(d["alias"])):
            bad.append(f"Join {at} needs a prefix of small letters, digits and _.")
        out.append((tuple((k.get("left"), k.get("right")) for k in keys), d.get("how", "left"), d.get("alias"), str(d.get("name") or "")))
    if bad:
        raise JoinError(bad)
    return [Join(*x) for x in out]


def clean_lookup(df: DataFrame, mapping: clean.Mapping | None = None) -> Lookup:
    """Cleaned as the main table is; without a mapping a column is numeric when nine in ten filled cells read."""
    done = clean.clean(df, clean.Mapping({c: "measure" if mapping and mapping.roles.get(c) == "measure" else "dimension" for c in clean.text_columns(df)}) if mapping else None)
    return Lookup(done.table.df.drop(ROW), done.table.numeric, done.rows_before, done.empty, done.duplicates)


def key_columns(table: AnalysisTable, join: Join, date_column: str | None, grain: str | None, order: str) -> list[tuple[Column, Column]]:
    """(left, right) key expressions: dates by label at the left's grain, numbers if the left column is one."""
    out = []
    for left, right in join.keys:
        a, b = F.col(f"`{left}`"), F.col(f"`{right}`").cast("string")
        if left == date_column and grain:
            out.append((F.nullif(a, F.lit("")), dates.label(dates.parse_date(b, order), grain)))
        elif left in table.numeric:
            out.append((a.cast("double"), numbers.key_number(b)))
        else:
            out.append((F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit(""))))
    return out


def repeated_keys(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a lookup that occur twice or more, most repeated first; keys with a null part match nothing."""
    complete = keyed.where(" and ".join(f"{k} is not null" for k in keys))
    return complete.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys)


def rename(taken: list[str], lookup: list[str], keys: set[str], alias: str) -> dict[str, str]:
    """Output names of a lookup's columns: ``alias.column`` on a clash, then ``_2``; key columns are dropped."""
    used, out = set(taken), {}
    for c in lookup:
        if c in keys:
            continue
        name = c if c not in used else f"{alias}.{c}"
        n = 2
        while name in used:
            name, n = f"{alias}.{c}_{n}", n + 1
        used.add(name)
        out[c] = name
    return out


def attached(table: AnalysisTable, lookup: Lookup, join: Join, alias: str, date_column: str | None, grain: str | None, order: str) -> tuple[DataFrame, DataFrame, list[str], dict[str, str]]:
    """(all rows with keys, the lookup's columns and ``_hit``; the lookup by key; key names; output names)."""
    pairs = key_columns(table, join, date_column, grain, order)
    keys = [f"_k{i}" for i in range(len(pairs))]
    names = rename(table.columns, lookup.df.columns, {r for _, r in join.keys}, alias)
    right = lookup.df.select(*[p[1].alias(k) for k, p in zip(keys, pairs, strict=True)], *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(names)], F.lit(True).alias("_hit"))
    complete = right.where(" and ".join(f"{k} is not null" for k in keys))
    # No hint: Spark broadcasts the lookup where its size allows, and merges by sorting beyond.
    both = table.df.withColumns({k: p[0] for k, p in zip(keys, pairs, strict=True)}).join(complete, keys, "left")
    return both, complete, keys, names


def refuse_repeats(lookups: list[tuple[str, DataFrame, list[str]]]) -> None:
    """JoinError for the first of (alias, lookup by key, key names) whose keys repeat; one job looks at all of them."""
    shown = [complete.select(F.lit(i).alias("at"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), *[F.xxhash64(*keys).alias("h")]) for i, (_, complete, keys) in enumerate(lookups)]
    counted = reduce(DataFrame.unionByName, shown).groupBy("at", "key", "h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy("at", F.desc("n"), "key").limit(4).collect()
    if found:
        first = [r for r in found if r["at"] == found[0]["at"]][:3]
        raise JoinError([f"The lookup {lookups[first[0]['at']][0]} repeats its key: {', '.join(r['key'] for r in first)}. Each key may occur once, or rows would multiply."])


def finished(table: AnalysisTable, both: DataFrame, lookup: Lookup, names: dict[str, str], *extra: str) -> AnalysisTable:
    own = [f"`{c}`" for c in table.df.columns]
    new = [(F.col(f"_r{i}") if c in lookup.numeric else F.coalesce(f"_r{i}", F.lit(""))).alias(n) for i, (c, n) in enumerate(names.items())]
    numeric = table.numeric | {n for c, n in names.items() if c in lookup.numeric}
    return AnalysisTable(both.select(*own, *new, *extra), numeric, table.order, table.roles)


def join_one(table: AnalysisTable, lookup: Lookup, join: Join, alias: str, date_column: str | None = None, grain: str | None = None, order: str = "day-first", check: bool = True) -> tuple[AnalysisTable, DataFrame]:
    """(merged table, one-row statistics). The lookup's keys are checked by a job of their own first."""
    both, complete, keys, names = attached(table, lookup, join, alias, date_column, grain, order)
    if check:
        refuse_repeats([(alias, complete, keys)])
    stats = join_stats(both, complete, keys)
    return finished(table, both.where("_hit") if join.how == "inner" else both, lookup, names), stats


def join_stats(both: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """rows_in, matched, unmatched, coverage (4 digits), empty_keys, lookup_unused."""
    blank = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    n, hit = F.count("*"), F.count_if("_hit")
    left = both.agg(n.alias("rows_in"), hit.alias("matched"), (n - hit).alias("unmatched"), F.round(F.coalesce(F.try_divide(hit.cast("double"), n.cast("double")), F.lit(0.0)), 4).alias("coverage"), F.coalesce(F.sum(blank), F.lit(0)).alias("empty_keys"))
    unused = lookup.join(both.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("lookup_unused"))
    return left.crossJoin(unused)  # two one-row frames


def merge(table: AnalysisTable, lookups: list[Lookup], joins: list[Join], date_column: str | None = None, grain: str | None = None, order: str = "day-first") -> Merged:
    """All joins in order; a later one may key on columns an earlier one brought."""
    bad = []
    known = set(table.columns)
    for j, look in zip(joins, lookups, strict=True):
        bad += [f"“{left}” is not a column of the table." for left, _ in j.keys if left not in known]
        bad += [f"“{right}” is not a column of the lookup." for _, right in j.keys if right not in look.df.columns]
        known |= set(look.df.columns)
    if sum(len(x.df.columns) for x in lookups) + len(table.columns) > MOST["columns"] + len(joins) * MOST["keys"]:
        bad.append(f"A merged table has at most {MOST['columns']} columns.")
    if bad:
        raise JoinError(bad)
    # All joins are left joins with a mark of their match; an inner one drops its rows at the end, so that one pass over
    # the merged rows counts for every join.
    aliases, now, looked, marks = assign_aliases(joins), table, [], []
    for i, (j, look, alias) in enumerate(zip(joins, lookups, aliases, strict=True)):
        held = AnalysisTable(now.df.drop(*marks), now.numeric, now.order, now.roles)
        both, complete, keys, names = attached(now, look, j, alias, date_column, grain, order)
        looked.append((alias, complete, keys))
        key = F.when(F.col("_hit"), F.struct(*keys))
        blank = F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)
        both = both.withColumns({f"_hit{i}": F.coalesce("_hit", F.lit(False)), f"_blank{i}": blank, f"_key{i}": key})
        now = finished(held, both, look, names, *marks, f"_hit{i}", f"_blank{i}", f"_key{i}")
        marks += [f"_hit{i}", f"_blank{i}", f"_key{i}"]
    refuse_repeats(looked)
    # Every merged row says of each join whether it took part, matched, lacked a key, and by which key; equal keys meet
    # before they are counted, in one pass and without a copy of the rows for each join.
    alive, told = F.lit(True), []
    for i, j in enumerate(joins):
        hit = alive & F.col(f"_hit{i}")
        key = [F.when(hit, F.xxhash64(*x)).alias(f"h{n}") for n, x in enumerate(([f"_key{i}"], [F.lit(1), f"_key{i}"]))]
        flags = [x.cast("long").alias(n) for n, x in (("came", alive), ("hit", hit), ("blank", alive & F.col(f"_blank{i}")))]
        told.append(F.struct(F.lit(i).alias("at"), *key, *flags))
        alive = hit if j.how == "inner" else alive
    each = now.df.select(F.explode(F.array(*told)).alias("x")).select("x.*").groupBy("at", "h0", "h1").agg(*[F.sum(c).alias(c) for c in ("came", "hit", "blank")])
    row = {r["at"]: r for r in each.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("came", "hit", "blank")], F.count("h0").alias("used")).collect()}
    sizes = [F.lit(i).alias("at") for i in range(len(joins))]
    counted = {r["at"]: r["n"] for r in reduce(DataFrame.unionByName, [c.select(at).groupBy("at").agg(F.count("*").alias("n")) for (_, c, _), at in zip(looked, sizes, strict=True)]).collect()}
    out = Merged(AnalysisTable(now.df.where(alive).drop(*marks), now.numeric, now.order, now.roles))
    for i, (j, look, alias) in enumerate(zip(joins, lookups, aliases, strict=True)):
        n, hit, blank, used = (row[i][c] for c in ("came", "hit", "blank", "used")) if i in row else (0, 0, 0, 0)
        figures = {"rows_in": n, "matched": hit, "unmatched": n - hit, "coverage": round(hit / n, 4) if n else 0.0, "empty_keys": blank, "lookup_unused": counted.get(i, 0) - used}
        out.stats.append(figures | {"alias": alias, "how": j.how, "rows_out": hit if j.how == "inner" else n, "dropped_empty": look.empty, "dropped_duplicates": look.duplicates})
    return out


def check_breakdown(merged: Merged, breakdown: str | None) -> None:
    if breakdown is not None and (breakdown not in merged.table.columns or breakdown in merged.table.numeric):
        raise JoinError([f"“{breakdown}” is not a text column of the merged table."])


def preview(merged: Merged, rows: int = 5) -> DataFrame:
    """The same plan the run uses, cut to its first rows in the table's order."""
    return merged.table.df.orderBy(*[F.col(f"`{c}`") for c in merged.table.order]).limit(rows)
