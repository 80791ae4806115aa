"""A glossary of metrics: formulas as columns, and how well recorded values keep to them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most inputs of each operation.
OPERATIONS = {"sum": (2, None), "multiply": (2, None), "subtract": (2, 2), "divide": (2, 2)}
#: Column names that suggest a measure, by the columns' own order.
MEASURE_HINTS = ("revenue", "sales", "amount", "value", "total")
#: A recorded value conforms within half a per cent of the defined one, or a hundredth.
TOLERANCE, LEAST_GAP = 0.005, 0.01


@dataclass(frozen=True)
class Metric:
    key: str
    name: str
    columns: tuple[str, ...]
    certified: bool = False
    owner: str | None = None
    formula: dict[str, Any] | None = None


@dataclass
class Glossary:
    """Metrics that read; ``problems`` tells why others did not."""

    metrics: list[Metric] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def load_glossary(source: str | Path | list[dict[str, Any]]) -> Glossary:
    """From JSON text, a file of it, or its parsed list. A missing file is an empty glossary; problems are returned."""
    out = Glossary()
    items: Any = source
    if not isinstance(source, list):
        try:
            text = str(source) if str(source).lstrip()[:1] in "[{" else Path(source).read_text(encoding="utf-8")
            items = json.loads(text)
        except FileNotFoundError:
            return out
        except (OSError, ValueError) as e:
            out.problems.append(f"The glossary could not be read: {e}")
            return out
    if isinstance(items, dict):
        items = items.get("metrics", [])
    seen: set[str] = set()
    for at, m in enumerate(items if isinstance(items, list) else []):
        bad = _metric_problems(m, at, seen)
        out.problems += bad
        if not bad:
            seen.add(m["key"])
            out.metrics.append(Metric(m["key"], m.get("name", m["key"]), tuple(m["columns"]), bool(m.get("certified")), m.get("owner"), m.get("formula")))
    return out


def _metric_problems(m: Any, at: int, seen: set[str]) -> list[str]:
    if not isinstance(m, dict) or not isinstance(m.get("key"), str) or not m["key"]:
        return [f"Entry {at + 1} has no key."]
    who, bad = f"Metric “{m['key']}”", []
    if m["key"] in seen:
        bad.append(f"{who} is defined twice.")
    if not isinstance(m.get("columns"), list) or not m["columns"] or not all(isinstance(c, str) and c for c in m["columns"]):
        bad.append(f"{who} names no columns.")
    if m.get("certified") and not m.get("owner"):
        bad.append(f"{who} is certified but has no owner.")
    if m.get("formula") is not None:
        bad += [f"{who}: {p}" for p in formula_problems(m["formula"])]
    return bad


def formula_problems(formula: Any) -> list[str]:
    if not isinstance(formula, dict) or formula.get("op") not in OPERATIONS:
        return [f"a formula is one of {', '.join(OPERATIONS)}."]
    inputs, (lo, hi) = formula.get("inputs"), OPERATIONS[formula["op"]]
    if not isinstance(inputs, list) or not all(isinstance(i, str) and i for i in inputs) or len(inputs) < lo or (hi and len(inputs) > hi):
        return [f"{formula['op']} takes {lo}{'' if hi else ' or more'} columns."]
    return []


def evaluate(formula: dict[str, Any]) -> Column:
    """A formula as a column: null where an input is missing or a denominator is 0."""
    first, *rest = [F.col(f"`{c}`").cast("double") for c in formula["inputs"]]
    for c in rest:
        first = {"sum": first + c, "multiply": first * c, "subtract": first - c, "divide": F.try_divide(first, c)}[formula["op"]]
    return first


def matches(recorded: Column, defined: Column) -> Column:
    return F.abs(recorded - defined) <= F.greatest(F.abs(defined) * TOLERANCE, F.lit(LEAST_GAP))


def conformance(df: DataFrame, column: str, formula: dict[str, Any]) -> DataFrame | None:
    """checked, matching, skipped and rate (4 digits) in one row; None where an input column is missing."""
    if any(c not in df.columns for c in [column, *formula["inputs"]]):
        return None
    recorded, defined = F.col(f"`{column}`"), evaluate(formula)
    both = recorded.isNotNull() & defined.isNotNull()
    ok = both & matches(recorded, defined)
    n, hit = F.count_if(both), F.count_if(ok)
    return df.agg(n.alias("checked"), hit.alias("matching"), (F.count("*") - n).alias("skipped"), F.round(F.try_divide(hit.cast("double"), n.cast("double")), 4).alias("rate"))


def breaches(df: DataFrame, column: str, formula: dict[str, Any], order: list[str], most: int = 3) -> DataFrame:
    """The rows whose recorded value is farthest from the defined one."""
    recorded, defined = F.col(f"`{column}`"), evaluate(formula)
    off = df.where(recorded.isNotNull() & defined.isNotNull() & ~matches(recorded, defined))
    out = off.select(*order, recorded.alias("recorded"), defined.alias("defined"), (recorded - defined).alias("gap"))
    return out.orderBy(F.abs(F.col("gap")).desc(), *order).limit(most)


def resolve_measure(metrics: list[Metric], columns: list[str], numeric: list[str]) -> tuple[str, Metric | None, str]:
    """(column, its metric, why): a certified metric, any metric, a telling name, else the first numeric column."""
    found, taken = [], set()
    for m in metrics:
        for name in m.columns:
            for c in numeric:
                if c.lower() == name.lower() and c not in taken:
                    taken.add(c)
                    found.append((c, m))
    for c, m in found:
        if m.certified:
            return c, m, "certified glossary metric"
    if found:
        return *found[0], "glossary metric, not certified"
    named = next((c for c in numeric if c.lower() in MEASURE_HINTS), None)
    return (named, None, "column name") if named else (numeric[0], None, "first numeric column")
