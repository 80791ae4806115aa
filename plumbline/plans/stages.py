"""Stages that report calculations, claims that cite them, and checks; and the run that audits them all.

A stage reads one shared, persisted analysis table and returns small figures. What a run says must be traceable:
every claim cites calculations that some stage produced.
"""

from __future__ import annotations

import copy
import hashlib
import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, clean, experiments, governance, joins
from ..operators.table import ROW, AnalysisTable

CLAIM_TYPES = ("calculation", "fact", "finding", "limitation", "warning", "recommendation", "assumption", "forecast")
#: Custom stages give everything but findings, within these sizes.
CUSTOM_TYPES = tuple(t for t in CLAIM_TYPES if t != "finding")
CUSTOM_MOST = {"claims": 50, "calculations": 200, "checks": 50, "text": 1000}
#: Groups that a card lists, the largest first; the frames behind it hold all.
TOP = 1000
LAST = ("lineage", "validator", "reporter", "publish")
DEFAULT_AFTER = "sensitivity"
#: The kinds of analysis that every run reports.
TYPES = ("descriptive", "diagnostic", "predictive", "prescriptive")


@dataclass
class Calculation:
    id: str
    name: str
    value: Any
    method: str


@dataclass
class Claim:
    id: str
    text: str
    type: str
    evidence: list[str]
    status: str = "supported"


@dataclass
class Check:
    name: str
    passed: bool
    detail: str = ""


@dataclass
class Result:
    status: str = "succeeded"
    summary: str = ""
    output: dict[str, Any] = field(default_factory=dict)
    calculations: list[Calculation] = field(default_factory=list)
    claims: list[Claim] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)

    def calc(self, id_: str, name: str, value: Any, method: str) -> str:
        self.calculations.append(Calculation(id_, name, value, method))
        return id_

    def claim(self, id_: str, kind: str, words: str, *evidence: str) -> None:
        self.claims.append(Claim(id_, words, kind, list(evidence)))

    def check(self, name: str, passed: bool, detail: str = "") -> None:
        self.checks.append(Check(name, bool(passed), detail))


@dataclass
class Context:
    """One run: the raw table, its mapping, glossary and options; results by stage; the shared analysis table.

    ``lookups`` are raw tables, each with how it is joined and its mapping or None; ``join_breakdown`` may name a column that one brings."""

    raw: DataFrame
    mapping: clean.Mapping | None = None
    glossary: governance.Glossary = field(default_factory=governance.Glossary)
    goal: str = ""
    lookups: list[tuple[DataFrame, joins.Join, clean.Mapping | None]] = field(default_factory=list)
    join_breakdown: str | None = None
    results: dict[str, Result] = field(default_factory=dict)
    cleaned: clean.Cleaned | None = None
    table: AnalysisTable | None = None
    measure: str | None = None
    breakdown: str | None = None
    by_group: DataFrame | None = None
    periods: DataFrame | None = None
    cells: DataFrame | None = None

    def counted(self) -> DataFrame:
        """The raw table's distinct cells, kept for the stages that read them."""
        if self.cells is None:
            self.cells = clean.counted(self.raw).persist()
        return self.cells

    def label(self) -> Any:
        return F.col(f"`{self.cleaned.date_column}`")


Stage = Callable[[Context], Result]


def _profile(ctx: Context) -> Result:
    out = Result()
    row = clean.completeness(ctx.raw).first()
    out.output = {"profile": [r.asDict() for r in clean.profile(ctx.raw, ctx.counted()).collect()], **row.asDict()}
    out.calc("c_rows", "rows", row["records"], "count of rows")
    out.calc("c_completeness", "completeness", row["completeness"], "1 - missing cells / all cells")
    out.calc("c_duplicates", "duplicates", row["duplicates"], "rows that repeat an earlier row")
    out.claim("cl_profile", "fact", f"The table has {row['records']} rows; {row['duplicates']} repeat an earlier one.", "c_rows", "c_duplicates")
    return out


def _contract(ctx: Context) -> Result:
    out = Result()
    fields = [r.asDict() for r in clean.contract(ctx.raw, ctx.counted()).collect()]
    out.output = {"fields": fields}
    out.calc("c_contract_fields", "columns_under_contract", len(fields), "one contract row per column")
    out.claim("cl_contract", "fact", f"The data has {len(fields)} columns under contract.", "c_contract_fields")
    broken = [f for f in fields if f["unreadable"]]
    if broken:
        out.claim("cl_contract_breach", "finding", "Some values do not match their column: " + "; ".join(f["name"] for f in broken[:3]) + ". Those cells count as missing.", "c_contract_fields")
    return out


def _quality(ctx: Context) -> Result:
    out = Result()
    row = clean.quality(ctx.raw, seen=ctx.counted()).first().asDict()
    out.output = row
    ids = [out.calc(f"c_dq_{k}", f"{k}_ratio", row[k], "share") for k in ("completeness", "uniqueness", "validity", "consistency")]
    out.calc("c_dq_score", "quality_score", row["score"], "mean of the four, times 100")
    out.claim("cl_quality", "finding", f"Data quality scores {row['score']} out of 100 (grade {row['grade']}).", "c_dq_score", *ids)
    out.check("quality_above_floor", row["score"] >= 50)
    return out


def _privacy(ctx: Context) -> Result:
    out = Result()
    found = [r.asDict() for r in clean.personal_columns(ctx.raw, ctx.counted()).collect()]
    out.output = {"findings": found, "personal_data": bool(found)}
    out.calc("c_pii_columns", "personal_columns", len(found), "columns matched by name or value")
    if found:
        out.claim("cl_privacy", "warning", "These columns look like personal data: " + ", ".join(f["name"] for f in found) + ".", "c_pii_columns")
    return out


def _clean(ctx: Context) -> Result:
    out = Result()
    ctx.cleaned = clean.clean(ctx.raw, ctx.mapping)
    if not ctx.cleaned.table.numeric:
        return Result("failed", "No column reads as numbers, so there is nothing to analyse.")
    ctx.table = ctx.cleaned.table.with_df(ctx.cleaned.table.df.persist())
    c = ctx.cleaned
    out.output = {"rows_before": c.rows_before, "rows_after": c.rows_after, "empty": c.empty, "duplicates": c.duplicates, "date_column": c.date_column, "grain": c.grain}
    out.calc("c_rows_kept", "rows_kept", c.rows_after, "rows that are neither empty nor repeats")
    out.calc("c_rows_dropped", "rows_dropped", c.empty + c.duplicates, "empty rows plus repeats")
    out.claim("cl_clean", "fact", f"{c.rows_after} of {c.rows_before} rows were kept; {c.empty + c.duplicates} were empty or repeats.", "c_rows_kept", "c_rows_dropped")
    out.check("row_accounting", c.rows_before == c.rows_after + c.empty + c.duplicates)
    return out


def _join(ctx: Context) -> Result:
    """Lookups beside each row: how many rows found a match is a figure, and no row is ever added."""
    out = Result()
    c = ctx.cleaned
    try:
        merged = joins.merge(ctx.table, [joins.clean_lookup(raw, mapping) for raw, _, mapping in ctx.lookups], [j for _, j, _ in ctx.lookups], c.date_column, c.grain, c.order or "day-first")
        joins.check_breakdown(merged, ctx.join_breakdown)
    except joins.JoinError as e:
        return Result("failed", str(e))
    private = [(j.name, r["name"]) for raw, j, _ in ctx.lookups for r in clean.personal_columns(raw).collect()]
    for i, (s, (_, j, _)) in enumerate(zip(merged.stats, ctx.lookups, strict=True)):
        keys, who = ", ".join(f"{a} = {b}" for a, b in j.keys), j.name or s["alias"]
        kept = "every row stays" if j.how == "left" else "rows with a match stay"
        out.calc(f"c_join_{i}_in", f"rows_before_{s['alias']}", s["rows_in"], "rows before this join")
        out.calc(f"c_join_{i}_matched", f"rows_matched_{s['alias']}", s["matched"], f"rows whose {keys} is in the lookup")
        out.calc(f"c_join_{i}_out", f"rows_after_{s['alias']}", s["rows_out"], kept)
        out.calc(f"c_join_{i}_coverage", f"coverage_{s['alias']}", s["coverage"], "matched rows / rows before this join")
        told = f"{s['matched']} of {s['rows_in']} rows found a match in {who}"
        out.claim(f"cl_join_{i}", "limitation" if s["unmatched"] else "fact", f"{told}; the others hold nothing in its columns." if s["unmatched"] else f"{told}.", f"c_join_{i}_in", f"c_join_{i}_matched", f"c_join_{i}_coverage")
        if j.how == "inner" and s["unmatched"]:
            out.claim(f"cl_join_{i}_left_out", "limitation", f"{s['unmatched']} rows without a match in {who} were left out, so totals are of {s['rows_out']} rows.", f"c_join_{i}_out", f"c_join_{i}_matched")
        out.check(f"join_{s['alias']}_adds_no_row", s["rows_out"] == (s["matched"] if j.how == "inner" else s["rows_in"]))
    if private:
        out.calc("c_join_private", "personal_columns_joined", len(private), "columns of lookups matched by name or value")
        out.claim("cl_join_private", "warning", "These joined columns look like personal data: " + ", ".join(f"{c} of {n}" if n else c for n, c in private) + ".", "c_join_private")
    ctx.table = merged.table.with_df(merged.table.df.persist())
    out.output = {"joins": merged.stats, "rows_after": ctx.table.df.count(), "personal_columns": [c for _, c in private]}
    return out


def _govern(ctx: Context) -> Result:
    out = Result()
    numeric = [c for c in ctx.table.columns if c in ctx.table.numeric]
    chosen, metric, why = governance.resolve_measure(ctx.glossary.metrics, ctx.table.columns, numeric)
    if ctx.mapping and ctx.mapping.measure:
        chosen, why = ctx.mapping.measure, "the mapping"
    ctx.measure = chosen
    texts = [c for c in ctx.table.columns if c not in ctx.table.numeric and c != ctx.cleaned.date_column]
    ctx.breakdown = ctx.join_breakdown or (ctx.mapping.dimension if ctx.mapping else None) or next(iter(texts), None)
    out.output = {"measure": chosen, "source": why, "certified": bool(metric and metric.certified), "owner": metric.owner if metric else None}
    out.calc("c_measure", "measure", chosen, why)
    out.claim("cl_measure", "fact", f"The analysis is about {chosen}, chosen by {why}.", "c_measure")
    if not out.output["certified"]:
        out.claim("cl_measure_uncertified", "limitation", f"{chosen} has no certified definition.", "c_measure")
    if metric and metric.formula and (row := governance.conformance(ctx.table.df, chosen, metric.formula)) is not None:
        r = row.first()
        out.output["conformance"] = r.asDict()
        out.calc("c_conformance", "conformance", r["rate"], "recorded values that match the formula, of those that could be checked")
        out.claim("cl_conformance", "finding", f"{r['matching']} of {r['checked']} values match the formula.", "c_conformance")
    return out


def _prepare(ctx: Context) -> Result:
    out = Result()
    df, m = ctx.table.df, f"`{ctx.measure}`"
    row = analysis.total(df, m).first()
    out.output = {"total": row["total"], "n": row["n"]}
    out.calc("c_total", "total", row["total"], f"sum of {ctx.measure}")
    if ctx.breakdown:
        ctx.by_group = analysis.groups(df, m, f"`{ctx.breakdown}`", ctx.table.order[0]).persist()
        parts = ctx.by_group.agg(F.sum(F.col("total").cast("decimal(28,2)")).cast("double")).first()[0] or 0.0
        out.check("groups_reconcile", abs(parts - (row["total"] or 0.0)) < 0.01 * max(1, ctx.by_group.count()))
    if ctx.cleaned.date_column:
        periods = analysis.trend(df, m, ctx.label()).persist()
        if analysis.few_periods(periods):
            ctx.periods = periods
        else:
            out.calc("c_periods", "periods", analysis.MOST_PERIODS, "the most that are taken for periods")
            out.claim("cl_periods", "limitation", f"“{ctx.cleaned.date_column}” holds more than {analysis.MOST_PERIODS} labels, so no trend over it is reported.", "c_periods")
    return out


def _segments(ctx: Context) -> Result:
    out = Result()
    shared = None if ctx.by_group is None else analysis.shares(ctx.by_group)
    if shared is None or not (rows := shared.orderBy("place").limit(TOP).collect()):
        out.calc("c_seg_none", "segments", 0, "no breakdown, or a total of zero")
        out.claim("cl_seg_none", "limitation", "No segment shares can be reported.", "c_seg_none")
        return out
    c = analysis.concentration(shared).first()
    out.output = {"shares": [r.asDict() for r in rows], "truncated": c["segments"] > len(rows), **c.asDict()}
    out.calc("c_seg_hhi", "concentration_index", c["hhi"], "sum of squared shares")
    out.calc("c_seg_pareto", "groups_to_80", c["pareto_count"], "groups that reach 80 per cent")
    out.claim("cl_seg", "finding", f"{c['pareto_count']} of {c['segments']} groups make up 80 per cent of {ctx.measure}.", "c_seg_pareto")
    return out


def _describe(ctx: Context) -> Result:
    out = Result()
    s = analysis.describe(ctx.table.df, f"`{ctx.measure}`").first()
    if not s["n"]:
        return Result("failed", f"{ctx.measure} has no usable value.")
    out.output = s.asDict()
    out.calc("c_mean", "mean", s["mean"], f"mean of {ctx.measure}")
    out.calc("c_median", "median", s["median"], f"median of {ctx.measure}")
    out.claim("cl_typical", "finding", f"A typical record holds {s['median']:,.2f}; the average is {s['mean']:,.2f}.", "c_mean", "c_median")
    if ctx.periods is not None:
        c = analysis.change(ctx.periods).first()
        out.output |= c.asDict()
        if c["change"] is not None:
            out.calc("c_change", "change", c["change"], "(last - first) / first period")
            out.claim("cl_change", "finding", f"{ctx.measure} changed by {c['change']:.1%} from {c['first_label']} to {c['last_label']}.", "c_change")
        if c["change_per_record"] is not None:
            out.calc("c_change_each", "change_per_record", c["change_per_record"], "the same per record")
            out.claim("cl_uneven", "warning", f"Periods hold unequal numbers of records; per record the change is {c['change_per_record']:.1%}.", "c_change_each")
    if ctx.by_group is not None and (t := analysis.top_group(ctx.by_group).first()):
        out.calc("c_topshare", "top_share", t["share"], "largest group's part of the total")
        out.output |= {"top_group": t["group"], "top_share": t["share"]}
    return out


def _diagnose(ctx: Context) -> Result:
    out = Result()
    if ctx.by_group is not None and ctx.periods is not None:
        moved = analysis.contributions(ctx.table.df, f"`{ctx.measure}`", f"`{ctx.breakdown}`", ctx.label())
        rows = moved.orderBy(F.abs("change").desc(), "group").limit(TOP + 1).collect()
        out.output["contributions"] = [r.asDict() for r in rows[:TOP]]
        out.output["contributions_truncated"] = len(rows) > TOP
        if rows:
            out.calc("c_totalchange", "total_change", rows[0]["total_change"], "last minus first period")
            parts, n = moved.agg(F.sum("change"), F.count("*")).first()
            ends = ctx.periods.agg(F.max_by("total", "label") - F.min_by("total", "label")).first()[0]
            # Each part is rounded to cents.
            out.check("change_reconciles", abs(parts - ends) < 0.01 * max(1, n))
            out.claim("cl_contrib", "finding", f"{rows[0]['group']} moved most, by {rows[0]['change']:,.2f}; this is where the change is, not why.", "c_totalchange")
    others = [c for c in ctx.table.columns if c in ctx.table.numeric and c != ctx.measure]
    if others:
        out.output["associations"] = [r.asDict() for r in analysis.associations(ctx.table.df.select(*[F.col(f"`{c}`").alias(c) for c in [ctx.measure, *others[:4]]]), ctx.measure, others).collect()]
    if not out.output:
        out.calc("c_diag_none", "explanations", 0, "no groups over time and no second measure")
        out.claim("cl_diag_none", "limitation", "Nothing in the table can explain a change.", "c_diag_none")
    return out


def _experiment(ctx: Context) -> Result:
    out = Result()
    df = ctx.table.df
    texts = [c for c in ctx.table.columns if c not in ctx.table.numeric and c != ctx.cleaned.date_column]
    found = experiments.find_column(df, texts)
    arms = experiments.arm_stats(df, F.col(f"`{found[0]}`"), F.col(f"`{ctx.measure}`")) if found else None
    if arms is None or arms.count() < 2:
        rows = experiments.sizes(df, F.col(f"`{ctx.measure}`")).collect()
        out.output = {"is_experiment": False, "sizing": [r.asDict() for r in rows]}
        out.calc("c_exp_sizes", "rows_per_arm", {str(r["lift"]): r["per_arm"] for r in rows}, "5 % risk, 80 % power")
        out.claim("cl_exp_none", "limitation", "The data hold no controlled comparison, so no cause is claimed.", "c_exp_sizes")
        return out
    rows = experiments.compare(arms).orderBy("arm").collect()
    out.output = {"is_experiment": True, "arms": [r.asDict() for r in rows]}
    for i, r in enumerate(rows):
        out.calc(f"c_exp_diff_{i}", f"difference_{r['arm']}", r["difference"], f"mean of {r['arm']} minus {r['baseline']}")
        verdict = "differs from" if r["beyond_chance"] else "is not shown to differ from"
        out.claim(f"cl_exp_{i}", "finding", f"{r['arm']} {verdict} {r['baseline']}: {r['low']:,.2f} to {r['high']:,.2f}.", f"c_exp_diff_{i}")
    return out


def _predict(ctx: Context) -> Result:
    out = Result()
    n = 0 if ctx.periods is None else ctx.periods.count()
    if n < analysis.LEAST_PERIODS:
        out.calc("c_periods", "periods", n, "periods with a total")
        out.claim("cl_forecast_none", "limitation", f"Only {n} periods are available; {analysis.LEAST_PERIODS} are needed for a forecast.", "c_periods")
        return out
    rows = analysis.labelled_forecast(ctx.periods).orderBy("step").collect()
    error = analysis.backtest(ctx.periods).first()
    out.output = {"forecast": [r.asDict() for r in rows], "backtest_error": error["error"] if error else None}
    for r in rows:
        out.calc(f"c_forecast_{r['step'] - 1}", f"forecast_{r['label']}", r["value"], "least-squares line continued")
    measured = f"a past test was off by {error['error']:.1%}" if error else "its accuracy could not be measured"
    out.claim("cl_forecast", "forecast", f"{ctx.measure} would be {rows[0]['value']:,.2f} in {rows[0]['label']}; {measured}.", "c_forecast_0")
    if not error:
        out.claim("cl_forecast_untested", "limitation", "The forecast was not tested on past periods.", "c_forecast_0")
    return out


def _anomaly(ctx: Context) -> Result:
    out = Result()
    rows = [] if ctx.periods is None else analysis.anomalies(ctx.periods).orderBy("label").collect()
    out.output = {"anomalies": [r.asDict() for r in rows]}
    out.calc("c_anomalies", "unusual_periods", len(rows), "periods far from the trend")
    out.claim("cl_anomalies", "finding", f"{len(rows)} periods lie far from the trend.", "c_anomalies")
    return out


def _options(ctx: Context) -> Result:
    out = Result()
    if ctx.by_group is None and ctx.periods is None:
        out.calc("c_options", "options", 0, "no groups and no forecast")
        out.claim("cl_options_none", "limitation", "Nothing can be recommended without groups or a forecast.", "c_options")
        return out
    contributed = analysis.contributions(ctx.table.df, f"`{ctx.measure}`", f"`{ctx.breakdown}`", ctx.label()) if ctx.periods is not None and ctx.by_group is not None else None
    ranked = analysis.options(ctx.by_group, contributed, bool(ctx.results.get("predictive", Result()).output.get("forecast"))) if ctx.by_group is not None else None
    rows = ranked.orderBy(F.desc("expected_gain"), "key").collect() if ranked is not None else []
    out.output = {"options": [r.asDict() for r in rows]}
    for r in rows:
        out.calc(f"c_option_{r['key']}", f"expected_gain_{r['key']}", r["expected_gain"], "10 per cent of the target's figure")
    if rows:
        out.claim("cl_recommend", "recommendation", f"First: {rows[0]['key'].replace('_', ' ')} ({rows[0]['target']}).", f"c_option_{rows[0]['key']}")
        out.claim("cl_uplift", "assumption", "Gains assume a 10 per cent improvement.", f"c_option_{rows[0]['key']}")
    return out


def _sensitivity(ctx: Context) -> Result:
    out = Result()
    rows = ctx.results["prescriptive"].output.get("options", [])
    out.calc("c_sens_n", "options_tested", len(rows), "options of the stage before")
    if len(rows) < 2:
        out.claim("cl_sens_none", "limitation", "With fewer than two options there is no ranking to test.", "c_sens_n")
        return out
    df = ctx.raw.sparkSession.createDataFrame([(r["key"], r["target"], r["base_value"], r["expected_gain"]) for r in rows], "key string, target string, base_value double, expected_gain double")
    won = analysis.sensitivity(df).collect()
    out.output = {"scenarios": [r.asDict() for r in won], "stable": len({r["winner"] for r in won}) == 1, "break_even": analysis.break_even(df).first()[0]}
    out.claim("cl_sens", "finding", "The recommendation holds at every assumed improvement." if out.output["stable"] else "The recommendation depends on the assumed improvement.", "c_sens_n")
    return out


def _visuals(ctx: Context) -> Result:
    return Result(output=analysis.charts(ctx.by_group, ctx.periods) if ctx.by_group is not None and ctx.periods is not None else {})


STAGES: dict[str, Stage] = {"contract": _contract, "profiler": _profile, "quality": _quality, "privacy": _privacy, "cleaner": _clean, "merge": _join, "governance": _govern, "preparer": _prepare, "segments": _segments, "descriptive": _describe, "diagnostic": _diagnose, "experiment": _experiment, "predictive": _predict, "anomaly": _anomaly, "prescriptive": _options, "sensitivity": _sensitivity, "visuals": _visuals}


# ---- custom stages


class CustomStage(Protocol):
    """``role`` names it and prefixes its ids; ``run`` gets a copy of the results and the table."""

    role: str

    def run(self, results: dict[str, Result], table: AnalysisTable) -> Result: ...


def load_custom(paths: list[str]) -> tuple[list[CustomStage], list[str]]:
    """Stages by dotted path ``module:Class``; problems are returned."""
    out, bad = [], []
    for p in paths:
        try:
            module, _, name = p.partition(":")
            stage = getattr(importlib.import_module(module), name)()
            if not getattr(stage, "role", "").isidentifier() or not callable(getattr(stage, "run", None)):
                raise TypeError("a stage has a role and a run method")
            if bad_place := misplaced(stage, [x.role for x in out]):
                raise ValueError(bad_place)
            out.append(stage)
        except (ImportError, AttributeError, TypeError, ValueError) as e:
            bad.append(f"{p}: {e}")
    return out, bad


def misplaced(stage: CustomStage, taken: list[str]) -> str | None:
    """Why a stage cannot run under its role or at its place: what audits the run comes after everything else."""
    after = getattr(stage, "after", DEFAULT_AFTER)
    if stage.role in STAGES or stage.role in LAST:
        return f"{stage.role} is a built-in stage"
    if stage.role in taken:
        return f"{stage.role} is there twice"
    if after in LAST:
        return f"{stage.role} asks to run after {after}, which audits every stage before it"
    return None if after in STAGES else f"{stage.role} asks to run after {after}, which is no stage"


def contract_problems(role: str, r: Result) -> list[str]:
    """What keeps a custom stage's result out."""
    bad = []
    for kind in ("claims", "calculations", "checks"):
        if len(getattr(r, kind)) > CUSTOM_MOST[kind]:
            bad.append(f"more than {CUSTOM_MOST[kind]} {kind}")
    bad += [f"{x.id} does not start with {role}." for x in [*r.claims, *r.calculations] if not x.id.startswith(f"{role}.")]
    bad += [f"{c.id} is a {c.type}" for c in r.claims if c.type not in CUSTOM_TYPES]
    bad += [f"{c.id} is too long" for c in r.claims if len(c.text) > CUSTOM_MOST["text"]]
    try:
        json.dumps([r.output, [c.value for c in r.calculations]])
    except (TypeError, ValueError):
        bad.append("the output is not JSON")
    return bad


# ---- audit


def lineage(results: dict[str, Result]) -> dict[str, list[str]]:
    """Calculations cited but not produced, and produced but not cited."""
    made = {c.id for r in results.values() for c in r.calculations}
    cited = {e for r in results.values() for c in r.claims for e in c.evidence}
    return {"dangling": sorted(cited - made), "unused": sorted(made - cited)}


def evidence_frame(spark, results: dict[str, Result]) -> tuple[DataFrame, DataFrame]:
    """(claims with one evidence a row, calculations): lineage as tables."""
    cited = [(s, c.id, e) for s, r in results.items() for c in r.claims for e in c.evidence]
    made = [(s, c.id, c.name, str(c.value), c.method) for s, r in results.items() for c in r.calculations]
    return spark.createDataFrame(cited, "stage string, claim string, calculation string"), spark.createDataFrame(made, "stage string, calculation string, name string, value string, method string")


def dangling(claims: DataFrame, calculations: DataFrame) -> DataFrame:
    return claims.join(calculations, "calculation", "left_anti")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: precision, recall, f1 (4 digits, null where undefined) and support."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    by = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hits = cells.where("t = g").select(F.col("t").alias("class"), F.col("n").alias("hit"))
    rows = by("t", "support").join(by("g", "guessed"), "class", "full").join(hits, "class", "left").na.fill(0, ["support", "guessed", "hit"])
    p, r = F.try_divide(F.col("hit").cast("double"), F.col("guessed").cast("double")), F.try_divide(F.col("hit").cast("double"), F.col("support").cast("double"))
    return rows.select("class", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"), "support")


def validate(ctx: Context) -> Result:
    """All rules that a run must keep before anything is published."""
    out = Result()
    traced = lineage(ctx.results)
    claims = [c for r in ctx.results.values() for c in r.claims]
    out.check("evidence_exists", not traced["dangling"], ", ".join(traced["dangling"]))
    out.check("claims_cite", all(c.evidence for c in claims))
    out.check("types_known", all(c.type in CLAIM_TYPES for c in claims))
    out.check("stage_checks", all(c.passed for r in ctx.results.values() for c in r.checks), "; ".join(c.name for r in ctx.results.values() for c in r.checks if not c.passed))
    kinds = {c.type for c in claims}
    out.check("recommendation_has_assumption", "recommendation" not in kinds or "assumption" in kinds)
    low = [c.id for c in claims if text.plain_jargon(c.text)]
    out.check("no_jargon", not low, ", ".join(low))
    output = lambda name: ctx.results.get(name, Result()).output
    said = {c.id for c in claims}
    personal = output("privacy").get("personal_data") or output("merge").get("personal_columns")
    out.check("personal_data_surfaced", not personal or bool(said & {"cl_privacy", "cl_join_private"}))
    out.check("forecast_measured_or_declared", "forecast" not in kinds or output("predictive").get("backtest_error") is not None or "cl_forecast_untested" in said)
    out.check("measure_certified_or_declared", bool(output("governance").get("certified")) or "cl_measure_uncertified" in said)
    out.check("every_type_reported", not (silent := [t for t in TYPES if not ctx.results.get(t, Result()).claims and not output(t)]), ", ".join(silent))
    # Counted again from the records, apart from the join's own check.
    now, broken = output("cleaner").get("rows_after"), []
    for s in output("merge").get("joins", []):
        if s["rows_in"] != now or s["rows_out"] != (s["matched"] if s["how"] == "inner" else now):
            broken.append(s["alias"])
        now = s["rows_out"]
    if "rows_after" in output("merge") and output("merge")["rows_after"] != now:
        broken.append("the merged table")
    out.check("joins_keep_rows", not broken, ", ".join(broken))
    out.output = {"passed": all(c.passed for c in out.checks), "claim_count": len(claims), **traced}
    if not out.output["passed"]:
        out.status = "failed"
    return out


def report(ctx: Context) -> str:
    """The run as Markdown: claims by stage with what they cite, the figures with how they came about, the checks."""
    lines = [f"# {ctx.goal or 'Analysis'}", ""]
    for name, r in ctx.results.items():
        if r.claims:
            lines += [f"## {name.replace('_', ' ').title()}", "", *[f"- {c.text} ({c.type}; {', '.join(c.evidence)})" for c in r.claims], ""]
    made = [c for r in ctx.results.values() for c in r.calculations]
    lines += ["## Figures", "", "| Figure | Value | Method |", "| --- | --- | --- |", *[f"| {c.name} | {c.value} | {c.method} |" for c in made], ""]
    checks = [c for r in ctx.results.values() for c in r.checks]
    lines += ["## Checks", "", *[f"- {'passed' if c.passed else 'FAILED'}: {c.name.replace('_', ' ')}" for c in checks], ""]
    return "\n".join(lines)


def run_custom(stage: CustomStage, ctx: Context) -> Result:
    try:
        r = stage.run(copy.deepcopy(ctx.results), ctx.table)
        bad = contract_problems(stage.role, r)
    except Exception as e:  # a plug-in's fault is its own
        r, bad = Result("failed"), [str(e)]
    return Result("failed", "; ".join(bad)) if bad else r


@dataclass(frozen=True)
class Approval:
    """Who approved which content: the hash binds it to the report as it was read."""

    by: str
    content: str


def content_hash(ctx: Context) -> str:
    return hashlib.sha256(report(ctx).encode()).hexdigest()


def approve(ctx: Context, by: str) -> Approval:
    if not ctx.results.get("validator", Result()).output.get("passed"):
        raise ValueError("The run did not pass its audit, so there is nothing to approve.")
    return Approval(by, content_hash(ctx))


def publish(ctx: Context, approval: Approval | None) -> str:
    """The report, if it is still the one that was approved."""
    if approval is None:
        raise ValueError("The report was not approved.")
    if approval.content != content_hash(ctx):
        raise ValueError("The report changed after it was approved; approve it again.")
    return report(ctx)


def run(ctx: Context, custom: list[CustomStage] | None = None) -> Context:
    """All stages in their order; a failed built-in stage ends the run, a failed custom one does not."""
    waiting = {}
    for i, stage in enumerate(custom or []):
        if bad := misplaced(stage, [x.role for x in (custom or [])[:i]]):
            raise ValueError(bad)
        # A stage gets the cleaned table, so one that asks for an earlier place runs as soon as that is there.
        after = getattr(stage, "after", DEFAULT_AFTER)
        waiting.setdefault(after if list(STAGES).index(after) >= list(STAGES).index("governance") else "governance", []).append(stage)
    for name, stage in STAGES.items():
        if name == "merge" and not ctx.lookups:
            continue
        ctx.results[name] = r = stage(ctx)
        if r.status == "failed":
            return ctx
        for own in waiting.get(name, []):
            ctx.results[own.role] = run_custom(own, ctx)
    ctx.results["lineage"] = Result(output=lineage(ctx.results))
    ctx.results["validator"] = validate(ctx)
    return ctx


def from_file(ingested, mapping: clean.Mapping | None = None, goal: str = "") -> Context:
    """A context for an ingested file, whose rows carry their numbers."""
    assert ROW in ingested.df.columns
    return Context(ingested.df, mapping, goal=goal)

