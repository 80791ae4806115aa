"""The four analytics types as frames: totals by group and period, change and its contributors, fits and
forecasts, unusual periods, options.

Rows are scanned once per grouping; everything after works on one row per group or period. Sums are decimal, so a
figure does not depend on the order of rows, and ratios are rounded to 4 digits, money to 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import next_labels
from ..functions.numbers import exact, exact_sum
from .table import running_sums, settled

HORIZON, LEAST_PERIODS, LEAST_BACKTEST = 3, 4, 6
#: Periods are uneven where the smallest has fewer records than this share of the largest.
EVEN_SHARE = 0.75
UPLIFTS = (0.05, 0.10, 0.20)


def _all() -> WindowSpec:
    """Over all rows of a frame that has one per period."""
    return Window.partitionBy()


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def groups(df: DataFrame, measure: str, by: str, order: str) -> DataFrame:
    """group, total, n, first_seen (least ``order``), of rows with the measure."""
    rows = df.where(F.col(measure).isNotNull())
    return rows.groupBy(F.col(by).alias("group")).agg(F.round(exact_sum(F.col(measure)), 2).alias("total"), F.count("*").alias("n"), F.min(order).alias("first_seen"))


def trend(df: DataFrame, measure: str, label: Column) -> DataFrame:
    """label, total, n by period; values without a label are left out."""
    rows = df.where(F.col(measure).isNotNull()).withColumn("label", label).where(F.col("label").isNotNull() & (F.col("label") != ""))
    return rows.groupBy("label").agg(F.round(exact_sum(F.col(measure)), 2).alias("total"), F.count("*").alias("n"))


#: Periods that a line may have: all of them meet in one task, and in a chart. Over 27 years of days.
MOST_PERIODS = 10_000


def few_periods(periods: DataFrame, most: int = MOST_PERIODS) -> bool:
    """Whether a column's labels are few enough to be periods; a column called "date" may hold any text."""
    return periods.limit(most + 1).count() <= most


def total(df: DataFrame, measure: str) -> DataFrame:
    return df.agg(F.round(exact_sum(F.col(measure)), 2).alias("total"), F.count(measure).alias("n"))


def describe(df: DataFrame, measure: str) -> DataFrame:
    """n, mean, median, sd (of a sample; 0 for one value), beyond_2sd. The squares are decimal sums as well."""
    x = F.col(measure)
    stats = df.agg(F.count(x).alias("n"), exact_sum(x).alias("s"), F.sum(exact(x) * exact(x)).cast("double").alias("q"), F.median(x).alias("median"))
    mean = _ratio(F.col("s"), F.col("n"))
    var = _ratio(F.col("q") - F.col("s") * mean, F.col("n") - 1)
    stats = stats.select("n", mean.alias("mean"), "median", F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)).alias("sd"))
    far = F.abs(x - F.col("mean")) > 2 * F.col("sd")
    both = df.select(x).join(F.broadcast(stats), how="cross")  # one row of figures
    return both.groupBy("n", "mean", "median", "sd").agg(F.count_if(far & (F.col("sd") > 0)).alias("beyond_2sd")).select("n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("sd", 4).alias("sd"), "beyond_2sd")


def change(periods: DataFrame) -> DataFrame:
    """First to last period: first_label, last_label, change and, where periods are uneven, change_per_record."""
    at = lambda f, c: f(F.struct("label", c))[c]
    first, last = at(F.min, "total"), at(F.max, "total")
    first_n, last_n = at(F.min, "n"), at(F.max, "n")
    each = lambda t, n: _ratio(t, n)
    uneven = F.min("n") < EVEN_SHARE * F.max("n")
    enough = (F.count("*") >= 2) & (first != 0)
    return periods.agg(
        F.count("*").alias("periods"),
        F.min("label").alias("first_label"),
        F.max("label").alias("last_label"),
        F.when(enough, F.round(_ratio(last - first, first), 4)).alias("change"),
        uneven.alias("uneven"),
        F.when(enough & uneven, F.round(_ratio(each(last, last_n) - each(first, first_n), each(first, first_n)), 4)).alias("change_per_record"),
    )


def top_group(by_group: DataFrame) -> DataFrame:
    """The largest group and its share; ties go to the group seen first."""
    whole = by_group.agg(F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("all"))
    return by_group.orderBy(F.desc("total"), "first_seen").limit(1).join(F.broadcast(whole), how="cross").select("group", "total", F.round(_ratio(F.col("total"), F.col("all")), 4).alias("share"))


def contributions(df: DataFrame, measure: str, by: str, label: Column) -> DataFrame:
    """Each group's change from the first to the last period and its share of the total change."""
    rows = df.where(F.col(measure).isNotNull()).select(F.col(by).alias("group"), label.alias("label"), exact(F.col(measure)).alias("x")).where(F.col("label").isNotNull() & (F.col("label") != ""))
    cells = rows.groupBy("group", "label").agg(F.sum("x").alias("x"))
    ends = rows.agg(F.min("label").alias("first"), F.max("label").alias("last"))
    at = cells.join(F.broadcast(ends), how="cross")  # one row of labels
    sums = settled(at.groupBy("group").agg(F.sum(F.when(F.col("label") == F.col("last"), F.col("x")).otherwise(0)).alias("b"), F.sum(F.when(F.col("label") == F.col("first"), F.col("x")).otherwise(0)).alias("a")))
    whole = sums.agg(F.sum(F.col("b") - F.col("a")).cast("double").alias("_all"))
    moved = sums.join(F.broadcast(whole), how="cross").select("group", F.round((F.col("b") - F.col("a")).cast("double"), 2).alias("change"), "_all")
    return moved.select("group", "change", F.round(_ratio(F.col("change"), F.col("_all")), 4).alias("share_of_change"), F.round("_all", 2).alias("total_change"))


def against_trend(contributed: DataFrame) -> DataFrame:
    """Groups that moved against the total."""
    return contributed.where(F.signum("change") * F.signum("total_change") < 0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows with both, from decimal sums; null under 3 pairs or where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, exact(x, 4)), F.when(both, exact(y, 4))
    n = F.count(F.when(both, 1)).cast("double")
    s = lambda c: F.sum(c).cast("double")
    sx, sy, sxx, syy, sxy = s(a), s(b), s(a * a), s(b * b), s(a * b)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((n >= 3) & ~flat & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def associations(df: DataFrame, measure: str, others: list[str]) -> DataFrame:
    """other, r (4 digits): at most four other measures, in one scan."""
    wide = df.agg(*[F.round(pearson(F.col(measure), F.col(c)), 4).alias(f"r{i}") for i, c in enumerate(others[:4])])
    rows = [F.struct(F.lit(c).alias("other"), F.col(f"r{i}").alias("r")) for i, c in enumerate(others[:4])]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def shares(by_group: DataFrame) -> DataFrame:
    """group, value, share, cumulative, place, largest first (ties by first seen): any number of groups, in ranges."""
    by_group = settled(by_group)
    whole = by_group.agg(F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("_all")).where("_all <> 0")
    out = by_group.join(F.broadcast(whole), how="cross").withColumn("share", F.round(_ratio(F.col("total"), F.col("_all")), 4))
    out = running_sums(out, F.col("share").cast("decimal(18,4)"), F.desc("total"), F.col("first_seen"), place="place", total="cumulative")
    return out.select("group", F.col("total").alias("value"), "share", F.col("cumulative").cast("double").alias("cumulative"), F.col("place").cast("int").alias("place"))


def concentration(shared: DataFrame) -> DataFrame:
    """segments, hhi (of shares rounded to 4 digits) and pareto_count, the groups that reach 80 per cent."""
    squares = F.sum(F.col("share").cast("decimal(18,4)") * F.col("share").cast("decimal(18,4)")).cast("double")
    return shared.agg(F.count("*").alias("segments"), F.round(squares, 4).alias("hhi"), F.least(F.count_if(F.col("cumulative") < 0.8) + 1, F.count("*")).alias("pareto_count"))


def numbered(periods: DataFrame) -> DataFrame:
    """Periods with x = 0, 1, ... in label order."""
    return periods.withColumn("x", (F.row_number().over(Window.orderBy("label")) - 1).cast("double"))


def _fit_columns(x: Column, y: Column, over=None) -> dict[str, Column]:
    s = lambda c: F.sum(c).over(over) if over is not None else F.sum(c)
    d = lambda c: c.cast("decimal(28,2)")
    n = (F.count(y).over(over) if over is not None else F.count(y)).cast("double")
    sx, sy = s(x), s(d(y)).cast("double")
    sxx, syy, sxy = s(x * x), s(d(y) * d(y)).cast("double"), s(d(y) * x.cast("int")).cast("double")
    vx, vy, vxy = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    slope = F.coalesce(F.try_divide(vxy, vx), F.lit(0.0))
    intercept = (sy - slope * sx) / n
    explained = F.when((vx > 0) & (vy > 0), vxy * vxy / vx / vy).otherwise(0.0)
    return {"slope": slope, "intercept": intercept, "explained": explained, "n": n}


def fit(periods: DataFrame) -> DataFrame:
    """slope, intercept, explained (0 for a constant series) and n of the least-squares line over positions."""
    made = _fit_columns(F.col("x"), F.col("total"))
    return numbered(periods).agg(*[v.alias(k) for k, v in made.items()]).withColumn("n", F.col("n").cast("long"))


def forecast(periods: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """step (1, 2, ...) and value; no rows under four periods."""
    line = fit(periods).where(F.col("n") >= LEAST_PERIODS)
    steps = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select("step", F.round(F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1), 2).alias("value"))


def labelled_forecast(periods: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The forecast with its periods' labels: one label is read back to continue the calendar."""
    last = periods.agg(F.max("label")).first()[0]
    labels = F.array(*[F.lit(x) for x in next_labels(str(last or ""), horizon)])
    return forecast(periods, horizon).select("step", F.element_at(labels, F.col("step")).alias("label"), "value")


def backtest(periods: DataFrame) -> DataFrame:
    """holdout and error: mean |gap| / |actual| over the last periods, from a line fitted before them."""
    rows = numbered(periods).withColumn("n", F.count("*").over(_all())).withColumn("holdout", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int"))))
    train = F.col("x") < F.col("n") - F.col("holdout")
    made = _fit_columns(F.when(train, F.col("x")), F.when(train, F.col("total")), _all())
    held = rows.withColumns({"slope": made["slope"], "intercept": made["intercept"]}).where(~train & (F.col("n") >= LEAST_BACKTEST) & (F.col("total") != 0))
    gap = F.abs(F.col("intercept") + F.col("slope") * F.col("x") - F.col("total")) / F.abs(F.col("total"))
    return held.groupBy("holdout").agg(F.round(F.avg(gap), 4).alias("error"))


def anomalies(periods: DataFrame) -> DataFrame:
    """Periods beyond two population deviations of the residuals: label, value, expected, gap, spread."""
    rows = numbered(periods)
    made = _fit_columns(F.col("x"), F.col("total"), _all())
    rows = rows.withColumns({"n": F.count("*").over(_all()), "expected": made["intercept"] + made["slope"] * F.col("x")}).withColumn("gap", F.col("total") - F.col("expected"))
    rows = rows.withColumn("spread", F.sqrt(F.avg(F.col("gap") * F.col("gap")).over(_all())))
    far = (F.col("n") >= LEAST_PERIODS) & (F.col("spread") > 0) & (F.abs("gap") > 2 * F.col("spread"))
    return rows.where(far).select("label", F.col("total").alias("value"), F.round("expected", 2).alias("expected"), F.round("gap", 2).alias("gap"), F.round("spread", 2).alias("spread"))


def options(by_group: DataFrame, contributed: DataFrame | None = None, has_forecast: bool = True, uplift: float = 0.10) -> DataFrame:
    """key, target, base_value, expected_gain: protect the leader, grow the laggard, recover the worst decline, or
    hold course. Each is one row of an ordered limit."""
    lead = by_group.orderBy(F.desc("total"), "first_seen").limit(1)
    last = by_group.orderBy(F.asc("total"), "first_seen").limit(1)
    row = lambda df, key: df.select(F.lit(key).alias("key"), F.col("group").cast("string").alias("target"), F.col("total").alias("base_value"))
    grow = row(last, "grow_laggard").join(F.broadcast(lead.select(F.col("group").cast("string").alias("target"))), "target", "left_anti").select("key", "target", "base_value")
    out = row(lead, "protect_leader").unionByName(grow)
    if contributed is not None:
        worst = contributed.where("change < 0").orderBy("change", "group").limit(1)
        out = out.unionByName(worst.select(F.lit("recover_decline").alias("key"), F.col("group").cast("string").alias("target"), F.abs("change").alias("base_value")))
    out = out.withColumn("expected_gain", F.round(F.col("base_value") * uplift, 2))
    if has_forecast:
        out = out.unionByName(out.sparkSession.createDataFrame([("hold_course", "the whole business", 0.0, 0.0)], "key string, target string, base_value double, expected_gain double"))
    return out


def sensitivity(ranked: DataFrame) -> DataFrame:
    """uplift, winner, gain for 5, 10 and 20 per cent: ties go to the key first in the alphabet."""
    each = ranked.withColumn("uplift", F.explode(F.array(*[F.lit(u) for u in UPLIFTS]))).withColumn("gain", F.round(F.col("base_value") * F.col("uplift"), 2))
    best = F.row_number().over(Window.partitionBy("uplift").orderBy(F.desc("gain"), "key"))
    return each.withColumn("_nth", best).where("_nth = 1").select("uplift", F.col("key").alias("winner"), "gain")


def break_even(ranked: DataFrame) -> DataFrame:
    """How many times the runner-up's uplift would have to be the winner's."""
    nth = F.row_number().over(Window.orderBy(F.desc("expected_gain"), "key"))
    two = ranked.withColumn("nth", nth).where("nth <= 2").agg(F.max(F.when(F.col("nth") == 1, F.col("base_value"))).alias("a"), F.max(F.when(F.col("nth") == 2, F.col("base_value"))).alias("b"))
    return two.select(F.round(_ratio(F.col("a"), F.col("b")), 3).alias("break_even"))


def charts(by_group: DataFrame, periods: DataFrame) -> dict[str, list]:
    """Small series for drawing: the eight largest groups, the line with its forecast."""
    top = [(r["group"], r["total"]) for r in by_group.orderBy(F.desc("total"), "first_seen").limit(8).collect()]
    line = [(r["label"], r["total"]) for r in periods.orderBy("label").collect()]
    ahead = [(r["label"], r["value"]) for r in labelled_forecast(periods).orderBy("step").collect()]
    return {"bar": top, "line": line + ahead, "forecast_from": ahead[0][0] if ahead else None}
