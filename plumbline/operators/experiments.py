"""Controlled comparisons: arms against a baseline with ranges that stay valid under peeking, and the sizes that
an experiment would need where the data hold none."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact, exact_sum

# Words that tell an experiment's column and its arms.
COLUMN_WORDS = ("variant", "treatment", "arm", "test_group", "testgroup", "experiment", "bucket", "ab_test", "abtest", "assignment", "group_assignment")
ARM_WORDS = ("control", "treatment", "holdout", "baseline", "variant")
BASELINES = ("control", "baseline", "holdout")
LIFTS = (0.05, 0.10, 0.20)
ALPHA, POWER, TUNED_TO = 0.05, 0.80, 1000
Z_SUM = NormalDist().inv_cdf(1 - ALPHA / 2) + NormalDist().inv_cdf(POWER)


def find_column(df: DataFrame, candidates: list[str]) -> tuple[str, list[str]] | None:
    """The first text column of 2 to 6 values that is named or labelled like an experiment, with its values."""
    if not candidates:
        return None
    counts = df.agg(*[F.count_distinct(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"c{i}") for i, c in enumerate(candidates)]).first()
    for i, c in enumerate(candidates):
        if 2 <= counts[f"c{i}"] <= 6:
            values = sorted(r[0] for r in df.select(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("v")).where("v is not null").distinct().collect())
            if any(w in c.lower() for w in COLUMN_WORDS) or {v.lower() for v in values} & set(ARM_WORDS):
                return c, values
    return None


def arm_stats(df: DataFrame, arm: Column, measure: Column) -> DataFrame:
    """arm, n, mean, var (of a sample) for arms of two rows or more; sums are decimal."""
    rows = df.where(measure.isNotNull() & arm.isNotNull() & (F.trim(arm.cast("string")) != "")).select(F.trim(arm.cast("string")).alias("arm"), measure.alias("x"))
    out = rows.groupBy("arm").agg(F.count("*").alias("n"), exact_sum(F.col("x")).alias("s"), F.sum(exact(F.col("x")) * exact(F.col("x"))).cast("double").alias("q"))
    mean = F.col("s") / F.col("n")
    return out.where("n >= 2").select("arm", "n", mean.alias("mean"), F.greatest((F.col("q") - F.col("s") * mean) / (F.col("n") - 1), F.lit(0.0)).alias("var"))


def tuning(alpha: float, size: int = TUNED_TO) -> float:
    term = -2 * math.log(alpha)
    return math.sqrt((term + math.log(term + 1)) / max(1, size))


def inflation(n: Column, alpha: Column) -> Column:
    """Multiplier of the standard error of a normal-mixture confidence sequence at sample size ``n``."""
    term = -2 * F.ln(alpha)
    scaled = n * (term + F.ln(term + 1)) / TUNED_TO
    return F.sqrt(2 * (scaled + 1) / scaled * F.ln(F.sqrt(scaled + 1) / alpha))


def compare(arms: DataFrame) -> DataFrame:
    """Every arm against the baseline (control, baseline or holdout, else first by name): difference, relative,
    always-valid low and high, fixed_low and fixed_high, beyond_chance. The risk is split over the comparisons."""
    everyone = Window.partitionBy()  # one row per arm
    rank = F.when(F.lower("arm").isin(*BASELINES), 0).otherwise(1)
    first = F.min(F.struct(rank.alias("r"), F.col("arm"), F.col("n"), F.col("mean"), F.col("var"))).over(everyone)
    rows = arms.withColumns({"b": first, "k": F.count("*").over(everyone) - 1}).where(F.col("arm") != F.col("b.arm"))
    alpha = F.lit(ALPHA) / F.col("k")
    z = F.element_at(F.array(*[F.lit(NormalDist().inv_cdf(1 - ALPHA / k / 2)) for k in range(1, 11)]), F.least(F.col("k"), F.lit(10)).cast("int"))
    diff = F.col("mean") - F.col("b.mean")
    error = F.sqrt(F.col("var") / F.col("n") + F.col("b.var") / F.col("b.n"))
    wide = error * inflation(F.least("n", "b.n"), alpha)
    beyond = lambda lo, hi: ((lo > 0) & (hi > 0)) | ((lo < 0) & (hi < 0))
    r = lambda c, name, k=2: F.round(c, k).alias(name)
    return rows.select("arm", F.col("b.arm").alias("baseline"), "n", r(F.col("mean"), "average"), r(diff, "difference"), r(F.try_divide(diff, F.abs("b.mean")), "relative", 4), r(diff - wide, "low"), r(diff + wide, "high"), r(diff - z * error, "fixed_low"), r(diff + z * error, "fixed_high"), beyond(diff - wide, diff + wide).alias("beyond_chance"), beyond(diff - z * error, diff + z * error).alias("beyond_chance_fixed"))


def lopsided(arms: DataFrame) -> DataFrame:
    """The arm farthest from an even split, and whether it is beyond three standard errors."""
    everyone = Window.partitionBy()
    rows = arms.withColumns({"all": F.sum("n").over(everyone), "k": F.count("*").over(everyone)})
    p = 1 / F.col("k")
    rows = rows.withColumns({"share": F.col("n") / F.col("all"), "gap": F.abs(F.col("n") / F.col("all") - p), "bound": 3 * F.sqrt(p * (1 - p) / F.col("all"))})
    return rows.orderBy(F.desc("gap"), "arm").limit(1).select("arm", F.round("share", 4).alias("share"), F.round("gap", 4).alias("gap"), (F.col("gap") > F.col("bound")).alias("lopsided"))


def _one(df: DataFrame, measure: Column) -> DataFrame:
    s, q, n = exact_sum(measure), F.sum(exact(measure) * exact(measure)).cast("double"), F.count(measure)
    out = df.agg(n.alias("n"), s.alias("s"), q.alias("q")).where("n >= 2")
    return out.select("n", (F.col("s") / F.col("n")).alias("mean"), F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)).alias("var"))


def sizes(df: DataFrame, measure: Column) -> DataFrame:
    """lift, per_arm: rows per arm to find a 5, 10 or 20 per cent change with 80 % power at 5 % risk."""
    rows = _one(df, measure).withColumn("lift", F.explode(F.array(*[F.lit(x) for x in LIFTS])))
    delta = F.abs("mean") * F.col("lift")
    return rows.select("lift", F.ceil(F.try_divide(F.lit(2 * Z_SUM**2) * F.col("var"), delta * delta)).cast("long").alias("per_arm"))


def smallest_change(df: DataFrame, measure: Column) -> DataFrame:
    """The least difference that the rows at hand could show, split evenly into two arms."""
    rows = _one(df, measure).where("n >= 4 and var > 0")
    return rows.select("n", F.round(F.lit(Z_SUM) * F.sqrt(2 * F.col("var") / (F.col("n") / 2)), 4).alias("smallest_change"))
