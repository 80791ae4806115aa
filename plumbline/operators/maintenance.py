"""The maintenance domain: its column contract, KPIs as ratios of sums, and risk targets with honest baselines."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_number, exact_sum
from . import models
from .detectors import Finding, run_all
from .table import settled

# Fields by name with scale and timing.
FIELDS: dict[str, tuple[str, str]] = {
    "Record_ID": ("identifier", "before"),
    "Record_Date": ("date", "before"),
    "Asset_ID": ("identifier", "before"),
    "Work_Order_Type": ("category", "before"),
    "Failure_Mode": ("category", "outcome"),
    "Criticality": ("category", "before"),
    "Maintenance_Strategy": ("category", "before"),
    "Site": ("category", "before"),
    "Technician_Team": ("category", "before"),
    "Shift": ("category", "before"),
    "Asset_Age_Years": ("count", "before"),
    "Operating_Hours": ("hours", "outcome"),
    "Planned_Operating_Hours": ("hours", "before"),
    "Downtime_Hours": ("hours", "outcome"),
    "Failure_Count": ("count", "outcome"),
    "Preventive_WO_Count": ("count", "outcome"),
    "Corrective_WO_Count": ("count", "outcome"),
    "Completed_WO_Count": ("count", "outcome"),
    "Overdue_WO_Count": ("count", "outcome"),
    "First_Time_Fix_Count": ("count", "outcome"),
    "Repeat_Repair_Count": ("count", "outcome"),
    "MTBF_Hours": ("hours", "derived"),
    "MTTR_Hours": ("hours", "derived"),
    "Maintenance_Cost_USD": ("money", "outcome"),
    "Spare_Parts_Cost_USD": ("money", "outcome"),
    "Labor_Cost_USD": ("money", "outcome"),
    "Production_Loss_USD": ("money", "outcome"),
    "Temperature_C": ("score", "unknown"),
    "Vibration_mm_s": ("score", "unknown"),
    "Pressure_Bar": ("score", "unknown"),
    "Condition_Score": ("score", "unknown"),
    "Availability_Pct": ("fraction", "derived"),
    "Utilization_Pct": ("fraction", "derived"),
    "SLA_Target_Hours": ("hours", "before"),
    "SLA_Actual_Hours": ("hours", "outcome"),
    "Inventory_Stockout_Count": ("count", "outcome"),
    "Spare_Parts_Lead_Days": ("count", "before"),
    "Safety_Incident_Count": ("count", "outcome"),
}
REQUIRED = ("Record_ID", "Record_Date", "Asset_ID")
EXCLUDED = {
    "outcome": "recorded after the outcome; using it leaks the target",
    "derived": "derived from outcome columns, so it carries their timing",
    "unknown": "reading time not established; an assumption to report",
}


def resolve(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """(column -> field, columns outside the contract); names match without case, spaces or signs."""
    flat = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())
    by = {flat(f): f for f in FIELDS}
    found = {c: by[flat(c)] for c in columns if flat(c) in by}
    return found, [c for c in columns if c not in found]


def tier(columns: list[str]) -> str:
    """maintenance, general or unusable."""
    have = set(resolve(columns)[0].values())
    measures = [f for f in have if FIELDS[f][0] in ("hours", "money", "count") and FIELDS[f][1] != "before"]
    if set(REQUIRED) <= have and len(measures) >= 3:
        return "maintenance"
    return "general" if len(columns) >= 2 else "unusable"


def model_inputs(columns: list[str]) -> tuple[list[str], dict[str, str]]:
    """(columns known before the outcome, why each other one is out)."""
    found, rest = resolve(columns)
    out = {c: "an identifier, not a measurement" if FIELDS[f][0] == "identifier" else EXCLUDED[FIELDS[f][1]] for c, f in found.items() if FIELDS[f][0] == "identifier" or FIELDS[f][1] != "before"}
    return [c for c in found if c not in out], out | {c: "not in the maintenance contract; timing unknown" for c in rest}


# ---- KPIs


@dataclass(frozen=True)
class Kpi:
    """Sum over sum over the rows of a population where both are measured; no denominator columns: per record."""

    key: str
    numerator: tuple[str, ...]
    denominator: tuple[str, ...] = ()
    population: Column | None = None
    needs: tuple[str, ...] = ()
    percent: bool = False

    def columns(self) -> tuple[str, ...]:
        return (*self.numerator, *self.denominator, *self.needs)

    def parts(self) -> tuple[Column, Column, Column, Column]:
        """(population, numerator, denominator, measurable) over columns that are numbers."""
        add = lambda names: sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
        num = add(self.numerator)
        den = add(self.denominator) if self.denominator else F.lit(1.0)
        pop = F.lit(True) if self.population is None else F.coalesce(self.population, F.lit(False))
        return pop, num, den, pop & num.isNotNull() & den.isNotNull()

    def aggregates(self) -> list[Column]:
        pop, num, den, ok = self.parts()
        k = self.key
        return [exact_sum(F.when(ok, num)).alias(f"{k}__n"), exact_sum(F.when(ok, den)).alias(f"{k}__d"), F.count_if(ok).alias(f"{k}__r"), F.count_if(~pop).alias(f"{k}__x"), F.count_if(pop & ~ok).alias(f"{k}__u")]

    def answer(self) -> Column:
        k, scale = self.key, 100 if self.percent else 1
        value = F.round(F.try_divide(F.col(f"{k}__n"), F.col(f"{k}__d")) * scale, 6)
        why = F.when(F.col(f"{k}__r") == 0, "nothing measurable").when(F.col(f"{k}__d") == 0, "denominator is zero")
        return F.struct(F.lit(k).alias("kpi"), value.alias("value"), why.alias("undefined"), F.col(f"{k}__r").alias("records"), F.col(f"{k}__x").alias("excluded"), F.col(f"{k}__u").alias("unmeasured"))

    def row_mean(self) -> Column:
        """The mean of rows' own ratios: another figure, never a substitute."""
        _, num, den, ok = self.parts()
        return F.round(F.avg(F.when(ok, F.try_divide(num, den))) * (100 if self.percent else 1), 6)


def register() -> list[Kpi]:
    corrective = F.lower(F.trim(F.col("Work_Order_Type"))) == "corrective"
    return [
        Kpi("preventive_share", ("Preventive_WO_Count",), ("Preventive_WO_Count", "Corrective_WO_Count"), percent=True),
        Kpi("first_time_fix", ("First_Time_Fix_Count",), ("Corrective_WO_Count",), corrective, ("Work_Order_Type",), True),
        Kpi("repeat_repair", ("Repeat_Repair_Count",), ("Corrective_WO_Count",), corrective, ("Work_Order_Type",), True),
        Kpi("overdue_share", ("Overdue_WO_Count",), ("Completed_WO_Count",), percent=True),
        Kpi("operating_share", ("Operating_Hours",), ("Planned_Operating_Hours",), percent=True),
        Kpi("downtime_per_record", ("Downtime_Hours",)),
        Kpi("loss_per_downtime_hour", ("Production_Loss_USD",), ("Downtime_Hours",)),
        Kpi("cost_per_operating_hour", ("Maintenance_Cost_USD",), ("Operating_Hours",)),
    ]


def computable(columns: list[str], kpis: list[Kpi]) -> tuple[list[Kpi], dict[str, list[str]]]:
    """(KPIs whose columns exist, missing columns of the others)."""
    lacking = {k.key: sorted(set(k.columns()) - set(columns)) for k in kpis}
    return [k for k in kpis if not lacking[k.key]], {k: v for k, v in lacking.items() if v}


def measured(df: DataFrame, kpis: list[Kpi]) -> DataFrame:
    """The columns that the KPIs read, each parsed once; others are not scanned."""
    numbers = sorted({c for k in kpis for c in (*k.numerator, *k.denominator)})
    kept = sorted({c for k in kpis for c in k.needs} - set(numbers))
    return df.select(*[as_number(df, c).alias(c) for c in numbers], *[F.col(f"`{c}`") for c in kept])


def row_mean(df: DataFrame, kpi: Kpi) -> DataFrame:
    return measured(df, [kpi]).agg(kpi.row_mean().alias("row_mean"))


def compute(df: DataFrame, kpis: list[Kpi] | None = None) -> DataFrame:
    """All KPIs in one aggregation: kpi, value, undefined (why), records, excluded, unmeasured."""
    able, _ = computable(df.columns, register() if kpis is None else kpis)
    wide = measured(df, able).agg(*[a for k in able for a in k.aggregates()])
    return wide.select(F.explode(F.array(*[k.answer() for k in able])).alias("x")).select("x.*")


# ---- risk


def asked(df: DataFrame, target: str) -> tuple[DataFrame, Column]:
    """(rows the question is about, their label, null where it was not measured)."""
    n = lambda c: as_number(df, c)
    if target == "repeat_failure":
        return df.where(F.lower(F.trim(F.col("Work_Order_Type"))) == "corrective"), n("Failure_Count") > 1
    if target == "sla_breach":
        return df, n("SLA_Actual_Hours") > n("SLA_Target_Hours")
    raise ValueError(f"no such target: {target}")


def labelled(df: DataFrame, target: str) -> DataFrame:
    """``df`` with ``label`` for rows the question is about and that were measured."""
    rows, label = asked(df, target)
    return rows.withColumn("label", label).where("label is not null")


def rule_guess(train: DataFrame, test: DataFrame, column: str, order: str) -> DataFrame:
    """(actual, predicted) of test rows by the commonest training label of their group, ties to the first seen."""
    g = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    counts = train.groupBy(g.alias("g"), "label").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = counts.groupBy("g").agg(F.max_by("label", F.struct(F.col("n"), -F.col("o"))).alias("guess"))
    whole = train.groupBy("label").agg(F.count("*").alias("n"), F.min(order).alias("o")).agg(F.max_by("label", F.struct(F.col("n"), -F.col("o"))).alias("common"))
    return test.select(g.alias("g"), F.col("label").alias("actual")).join(best, "g", "left").crossJoin(whole).select("actual", F.coalesce("guess", "common").alias("predicted"))


def rule_counts(rows: DataFrame, column: str, order: str, n: str | None = None) -> DataFrame:
    """(actual, predicted, n): ``rule_guess`` of rows with ``label`` and ``held_out``, counted. The rows are read once, to
    counts by group, label and side; train and test, groups and whole are made of these. ``n`` names a count of equal rows."""
    g = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    counts = settled(rows.groupBy(g.alias("g"), "label", "held_out").agg(models.how_many(n).alias("n"), F.min(order).alias("o")))
    train, test = counts.where(~F.col("held_out")), counts.where("held_out")
    best = train.groupBy("g").agg(F.max_by("label", F.struct(F.col("n"), -F.col("o"))).alias("guess"))
    whole = train.groupBy("label").agg(F.sum("n").alias("n"), F.min("o").alias("o")).agg(F.max_by("label", F.struct(F.col("n"), -F.col("o"))).alias("common"))
    told = test.join(best, "g", "left").crossJoin(whole).select(F.col("label").alias("actual"), F.coalesce("guess", "common").alias("predicted"), "n")
    return told.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def best_rule(rows: DataFrame, candidates: list[str], order: str, most_rules: int = 8, most_groups: int = 12, n: str | None = None) -> tuple[str | None, float]:
    """The grouping whose rule scores best on the held-out rows: what a person would do without a model. ``n`` names a count
    of equal rows."""
    best: tuple[str | None, float] = (None, 0.0)
    if not candidates:
        return best
    tried = candidates[:most_rules]
    groups = rows.where(~F.col("held_out")).agg(*[F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"g{i}") for i, c in enumerate(tried)]).first()
    for i, c in enumerate(tried):
        if 2 <= groups[f"g{i}"] <= most_groups:
            score = models.balanced_accuracy(rule_counts(rows, c, order, n)).first()[0] or 0.0
            if score > best[1]:
                best = (c, score)
    return best


def counted(df: DataFrame, label: Column, numeric: list[str], texts: list[str], date: str | None, order: str) -> DataFrame:
    """Rows with a label that agree in all that ``risk`` reads, as one with their count ``n``: the inputs, ``label``, ``_date`` and
    ``_first``, the least ``order``. Whether ``order`` is a multiple of 5 is agreed on too, so the first answers for all.

    The table is read once, and a cell is parsed once. Unlabelled rows go afterwards: a filter before the count would be
    evaluated with the label's cells parsed again."""
    place = as_number(df, order) if order in numeric else F.col(f"`{order}`")
    dates = [F.col(f"`{date}`").cast("string").alias("_date")] if date else []
    keys = [*[F.col(f"`{c}`") for c in texts], *[as_number(df, c).alias(c) for c in numeric], label.cast("string").alias("label"), (place % 5 == 0).alias("_fifth"), *dates]
    return settled(df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("_first"))).where("label is not null")


def risk(df: DataFrame, target: str, date: str = "Record_Date", order: str = "_row_id") -> dict[str, Any]:
    """A card: useful only if the model beats the better baseline by 5 per cent and reaches 0.55; the claim follows
    the verdict."""
    rows, label = asked(df, target)
    usable, excluded = model_inputs(df.columns)
    defines = {"repeat_failure": {"Failure_Count", "Work_Order_Type"}, "sla_breach": {"SLA_Target_Hours", "SLA_Actual_Hours"}}[target]
    usable = [c for c in usable if resolve([c])[0][c] not in defines | {"Record_Date"}]
    numeric = [c for c in usable if FIELDS[resolve([c])[0][c]][0] in ("count", "hours", "money", "score", "fraction")]
    texts = [c for c in usable if c not in numeric]
    numeric = numeric[: models.MOST_NUMBERS]
    dated = date if date in df.columns else None
    rows = models.split(counted(rows, label, numeric, texts, dated, order), "_date" if dated else None, "_first")
    complete = models.Inputs(numeric, [F.col(f"`{c}`") for c in numeric]).complete()
    # Levels and rules ask for texts alone, which agree in more rows.
    told = settled(rows.groupBy(*[F.col(f"`{c}`") for c in texts], "label", "held_out", complete.alias("_complete")).agg(F.sum("n").alias("n"), F.min("_first").alias("_first")))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    n_train, n_test, classes = told.agg(side(~F.col("held_out")), side(F.col("held_out")), F.count_distinct("label")).first()
    if n_train < 30 or n_test < 50 or classes < 2:
        return {"target": target, "fitted": False, "train": n_train, "test": n_test}
    inputs = models.Inputs.of(told.where(~F.col("held_out")), numeric, texts, "_first", "n")
    rows = rows.where(complete)
    train, test = rows.where(~F.col("held_out")), rows.where("held_out")
    x = models.scaled(train, inputs.columns, "n")
    model = models.naive_bayes(train, x, F.col("label"), "n").collect()
    held = test.select(F.col("label").alias("actual"), models.classify(model, x).alias("predicted"), "n")
    score = models.balanced_accuracy(held).first()[0] or 0.0
    rule, rule_score = best_rule(told.where("_complete"), texts, "_first", n="n")
    baseline = max(1.0 / classes, rule_score)
    useful = models.improvement(score, baseline, False) >= models.BEATS and score >= 0.55
    return {"target": target, "fitted": True, "train": n_train, "test": n_test, "score": score, "baseline": baseline, "rule": rule, "verdict": "useful" if useful else "weak", "claim": "finding" if useful else "limitation", "excluded": excluded}


def govern(df: DataFrame, order: str = "_row_id", fail_on_high: bool = False, skip: tuple[str, ...] = (), most_cells: int | None = None) -> list[Finding]:
    """Detector findings of a maintenance table; ``fail_on_high`` refuses a table with a severe one. Detectors that the
    table is too wide for, or that ``most_cells`` bars, are findings by name."""
    found = run_all(df, order, "Record_Date" if "Record_Date" in df.columns else None, skip, most_cells=most_cells)
    if fail_on_high and any(f.severity == "high" for f in found):
        raise ValueError("The table was refused: " + "; ".join(f.headline for f in found if f.severity == "high"))
    return found

