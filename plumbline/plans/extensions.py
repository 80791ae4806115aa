"""Stages beyond the built-in ones: models and maintenance diagnostics, the profiles that choose them, and an example.

A custom stage has a ``role``, may name the built-in stage it runs ``after``, and gets a copy of the results and the
shared table. Everything it reports is audited with the rest.
"""

from __future__ import annotations

from typing import Any

from ..operators import maintenance, models
from ..operators.table import ROW, AnalysisTable, number_rows
from .stages import Result


def _figures(role: str, out: Result, card: dict[str, Any], names: tuple[str, ...]) -> list[str]:
    return [out.calc(f"{role}.{n}", n, card[n], "held-out rows against the baseline") for n in names if card.get(n) is not None]


def _inputs(table: AnalysisTable, measure: str | None) -> tuple[list[str], list[str]]:
    numeric = [c for c in table.columns if c in table.numeric and c != measure]
    return numeric, [c for c in table.columns if c not in table.numeric]


def _ordered(table: AnalysisTable) -> AnalysisTable:
    """With ``_row_id``, which tables from files carry and others get from the columns that order them."""
    return table if ROW in table.df.columns else table.with_df(number_rows(table.df, *table.order))


class _Model:
    after = "sensitivity"

    def told(self, card: dict[str, Any], names: tuple[str, ...], useful: str, weak: str) -> Result:
        out = Result(output={k: v for k, v in card.items() if isinstance(v, (str, int, float, bool, list, dict))})
        ids = _figures(self.role, out, card, names)
        ids = ids or [out.calc(f"{self.role}.rows", "rows", card.get("rows", card.get("periods", 0)), "rows that could be used")]
        if not card.get("fitted"):
            out.claim(f"{self.role}.cl", "limitation", "There are too few usable rows to fit this model.", *ids)
        else:
            good = card["verdict"] in ("useful", "found")
            out.claim(f"{self.role}.cl", "calculation" if good else "limitation", useful if good else weak, *ids)
        return out


class RegressionModel(_Model):
    role = "regression_model"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        measure = results["governance"].output["measure"]
        numeric, texts = _inputs(table, measure)
        card = models.regression(_ordered(table).df, numeric, texts, measure)
        return self.told(card, ("error", "baseline_error", "explained"), "The other columns tell the measure better than its mean.", "The other columns tell the measure no better than its mean.")


class ClassificationModel(_Model):
    role = "classification_model"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        measure = results["governance"].output["measure"]
        numeric, texts = _inputs(table, measure)
        card = models.classification(_ordered(table).df, numeric, texts, None, measure)
        return self.told(card, ("score", "baseline"), "The top quarter can be told from the other columns.", "The top quarter cannot be told from the other columns.")


class ClusteringModel(_Model):
    role = "clustering_model"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        numeric = [c for c in table.columns if c in table.numeric]
        card = models.clusters(_ordered(table).df, numeric) if numeric else {"fitted": False}
        return self.told(card, ("k", "silhouette"), "The records fall into separate groups.", "The records form no clear groups.")


class SeasonalModel(_Model):
    role = "seasonal_model"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        from pyspark.sql import functions as F

        from ..operators import analysis

        clean = results["cleaner"].output
        if not clean.get("date_column"):
            return self.told({"fitted": False, "periods": 0}, (), "", "")
        periods = analysis.trend(table.df, f"`{results['governance'].output['measure']}`", F.col(f"`{clean['date_column']}`"))
        if not analysis.few_periods(periods):
            return self.told({"fitted": False, "periods": analysis.MOST_PERIODS}, (), "", "")
        card = models.seasonal(periods, clean.get("grain") or "month")
        return self.told(card, ("error", "baseline_error"), "A season repeats and helps the forecast.", "No season helps the forecast.")


class MaintenanceGovernance:
    role, after = "maintenance_governance", "quality"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        out = Result()
        kind = maintenance.tier(table.columns)
        found = maintenance.govern(_ordered(table).df)
        out.output = {"tier": kind, "findings": [f.headline for f in found]}
        n = out.calc(f"{self.role}.findings", "findings", len(found), "detectors that fired")
        out.calc(f"{self.role}.tier", "tier", kind, "fields of the maintenance contract that are there")
        out.claim(f"{self.role}.cl", "warning" if found else "fact", f"{len(found)} structural problems were found.", n)
        return out


class MaintenanceRisk:
    role, after = "maintenance_risk", "sensitivity"

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        out = Result()
        have = set(table.columns)
        needs = {"repeat_failure": {"Work_Order_Type", "Failure_Count"}, "sla_breach": {"SLA_Actual_Hours", "SLA_Target_Hours"}}
        able = [t for t, c in needs.items() if c <= have]
        if not able:
            n = out.calc(f"{self.role}.targets", "targets", 0, "targets whose columns are there")
            out.claim(f"{self.role}.cl", "limitation", "No risk target can be labelled from these columns.", n)
        for t in able:
            card = maintenance.risk(_ordered(table).df, t)
            out.output[t] = {k: v for k, v in card.items() if k != "excluded"}
            n = out.calc(f"{self.role}.{t}", t, card.get("score", 0.0), "balanced accuracy on held-out rows")
            good = card.get("verdict") == "useful"
            out.claim(f"{self.role}.cl_{t}", "calculation" if good else "limitation", f"{t.replace('_', ' ')} {'can' if good else 'cannot'} be told better than by a simple rule.", n)
        return out


class TargetAttainment:
    """Example: how far a total is from a target, which is a decision and comes from outside the data."""

    role, after = "target_attainment", "sensitivity"

    def __init__(self, target: float, label: str = "target"):
        self.target, self.label = float(target), label

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result:
        if self.target <= 0:
            return Result("failed", f"The {self.label} must be above zero; it is {self.target}.")
        total = results["preparer"].output["total"] or 0.0
        out = Result(output={"target": self.target, "attainment": round(total / self.target, 4), "gap": round(self.target - total, 2), "met": total >= self.target})
        out.calc(f"{self.role}.target", self.label, self.target, "set by the owner")
        share = out.calc(f"{self.role}.attainment", "attainment", out.output["attainment"], "total / target")
        gap = out.calc(f"{self.role}.gap", "gap", out.output["gap"], "target - total; below zero where it is exceeded")
        words = "it was met" if out.output["met"] else f"{out.output['gap']:,.2f} is missing"
        out.claim(f"{self.role}.cl", "calculation", f"{total / self.target:.0%} of the {self.label} was reached; {words}.", share, gap, "c_total")
        out.check("target_above_zero", True)
        return out


REGISTERED = {s.role: s for s in (RegressionModel, ClassificationModel, ClusteringModel, SeasonalModel, MaintenanceGovernance, MaintenanceRisk)}
PROFILES: dict[str, tuple[str, ...]] = {
    "default": (),
    "models": ("regression_model", "classification_model", "clustering_model", "seasonal_model"),
    "maintenance": ("maintenance_governance", "maintenance_risk"),
}


def stages_for(profile: str | None = None, profiles: dict[str, tuple[str, ...]] | None = None, registered: dict[str, Any] | None = None) -> list[Any]:
    """The stages that a profile names; without one the default profile's, or all where there is none."""
    profiles, registered = PROFILES if profiles is None else profiles, REGISTERED if registered is None else registered
    if profile is not None and profile not in profiles:
        raise ValueError(f"There is no profile “{profile}”; there are {', '.join(sorted(profiles)) or 'none'}.")
    names = profiles.get(profile or "default", tuple(registered))
    if unknown := [n for n in names if n not in registered]:
        raise ValueError(f"The profile “{profile or 'default'}” names stages that are not registered: {', '.join(unknown)}.")
    return [registered[n]() for n in names]
