"""Small models against a baseline: every statistic is a distributed aggregation, and only matrices as wide as the
inputs (a few dozen numbers) are solved on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .table import ROW, running_sums, settled

LEAST_ROWS, BEATS, SEPARATED = 30, 0.05, 0.25
MOST_NUMBERS, MOST_TEXTS, MOST_LEVELS, MOST_CLASSES = 12, 3, 10, 6
RIDGE, LEAST_SPREAD = 1e-3, 1e-3
ROWS_A_TASK = 100_000
SEASONS = {"day": 7, "month": 12, "quarter": 4}


def how_many(n: str | None) -> Column:
    """The number of rows, or of those that the rows stand for where column ``n`` counts equal ones."""
    return F.count("*") if n is None else F.sum(n)


@dataclass
class Inputs:
    """Numeric inputs and one-hot text inputs; each text column's most common level has no column."""

    names: list[str]
    columns: list[Column]

    @classmethod
    def of(cls, df: DataFrame, numbers: list[str], texts: list[str], order: str = ROW, n: str | None = None) -> Inputs:
        names, columns = list(numbers[:MOST_NUMBERS]), [F.col(f"`{c}`").cast("double") for c in numbers[:MOST_NUMBERS]]
        used = 0
        for c in texts:
            if used == MOST_TEXTS:
                break
            levels = df.groupBy(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")).agg(how_many(n).alias("n"), F.min(order).alias("o")).orderBy(F.desc("n"), "o").limit(MOST_LEVELS + 1).collect()
            if 2 <= len(levels) <= MOST_LEVELS:
                used += 1
                for r in levels[1:]:
                    names.append(f"{c} = {r['v']}")
                    columns.append((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) == r["v"]).cast("double"))
        return cls(names, columns)

    def vector(self) -> Column:
        return F.array(*self.columns)

    def complete(self) -> Column:
        out = F.lit(True)
        for c in self.columns:
            out = out & c.isNotNull()
        return out


def split(df: DataFrame, date: str | None = None, order: str = ROW) -> DataFrame:
    """With ``held_out``: the latest fifth of five periods or more, else every fifth row in order (ordinals are
    the row numbers that ingest gave)."""
    if date is not None:
        periods = df.where(F.col(date).isNotNull() & (F.col(date).cast("string") != "")).select(F.col(date).cast("string").alias("p")).distinct()
        place = F.row_number().over(Window.orderBy("p")) - 1  # one row per period
        ranked = periods.select("p", place.alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
        first = ranked.where(F.col("i") == F.floor(F.col("n") * 0.8)).where("n >= 5").select("p").first()
        if first:
            return df.where(F.col(date).isNotNull() & (F.col(date).cast("string") != "")).withColumn("held_out", F.col(date).cast("string") >= first["p"])
    return df.withColumn("held_out", F.col(order) % 5 == 0)


def _moments(df: DataFrame, x: list[Column], y: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and cross products of (inputs, target), in one aggregation of k * k / 2 sums."""
    v = [*x, y]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    row = df.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(v)], *[F.sum(v[i] * v[j]).alias(f"q{i}_{j}") for i, j in pairs]).first()
    sums = np.array([row[f"s{i}"] or 0.0 for i in range(len(v))])
    cross = np.zeros((len(v), len(v)))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = row[f"q{i}_{j}"] or 0.0
    return row["n"], sums, cross


def least_squares(df: DataFrame, inputs: list[Column], target: Column, ridge: float = RIDGE) -> tuple[list[float], float]:
    """(coefficients, intercept) of centred least squares; ``ridge`` per row on the diagonal, none on the intercept."""
    n, sums, cross = _moments(df, inputs, target)
    k = len(inputs)
    if not n or not k:
        return [0.0] * k, float(sums[-1] / n) if n else 0.0
    centred = cross - np.outer(sums, sums) / n
    coefficients = np.linalg.solve(centred[:k, :k] + ridge * n * np.eye(k), centred[:k, k])
    return coefficients.tolist(), float(sums[-1] / n - coefficients @ (sums[:k] / n))


def linear(coefficients: list[float], intercept: float, inputs: list[Column]) -> Column:
    out = F.lit(float(intercept))
    for w, c in zip(coefficients, inputs, strict=True):
        out = out + F.lit(float(w)) * c
    return out


def scaled(df: DataFrame, inputs: list[Column], n: str | None = None) -> list[Column]:
    """Inputs by training mean and population deviation (1 where constant). Where ``n`` counts equal rows, none may be null."""
    if n is not None:
        return _scaled_counts(df, inputs, F.col(n))
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(inputs)]).first()
    return [(c - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"d{i}"] or 1.0) for i, c in enumerate(inputs)]


def _scaled_counts(df: DataFrame, inputs: list[Column], n: Column) -> list[Column]:
    """Means first, then deviations from them. A constant is its own mean, which a rounded sum may miss."""
    row = df.agg(*[x for i, c in enumerate(inputs) for x in ((F.sum(n * c) / F.sum(n)).alias(f"m{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    means = [F.lit((row[f"lo{i}"] if row[f"lo{i}"] == row[f"hi{i}"] else row[f"m{i}"]) or 0.0) for i in range(len(inputs))]
    off = df.agg(*[F.sqrt(F.sum(n * (c - m) ** 2) / F.sum(n)).alias(f"d{i}") for i, (c, m) in enumerate(zip(inputs, means, strict=True))]).first()
    return [(c - m) / F.lit(off[f"d{i}"] or 1.0) for i, (c, m) in enumerate(zip(inputs, means, strict=True))]


def improvement(model: float, baseline: float, lower: bool) -> float:
    return 0.0 if not baseline else ((baseline - model) if lower else (model - baseline)) / abs(baseline)


def regression(df: DataFrame, numbers: list[str], texts: list[str], target: str, date: str | None = None, order: str = ROW) -> dict[str, Any]:
    """A card: coefficients, mean absolute error against the training mean's, R2 on held-out rows, verdict."""
    rows = split(df.where(F.col(target).isNotNull()), date, order)
    inputs = Inputs.of(df, numbers, texts, order)
    rows = rows.where(inputs.complete())
    x, y = inputs.columns, F.col(target).cast("double")
    n = rows.count()
    if n < LEAST_ROWS or not x:
        return {"fitted": False, "rows": n}
    train, test = rows.where(~F.col("held_out")), rows.where("held_out")
    x = scaled(train, x)
    weights, base = least_squares(train, x, y)
    mean = train.agg(F.avg(y)).first()[0]
    guess = linear(weights, base, x)
    seen = test.agg(F.count("*"), F.avg(F.abs(y - guess)), F.avg(F.abs(y - mean)), F.sum((y - guess) ** 2), F.sum((y - F.lit(mean)) ** 2)).first()
    gain = improvement(seen[1], seen[2], True)
    return {"fitted": True, "rows": n, "held_out": seen[0], "inputs": dict(zip(inputs.names, weights, strict=True)), "intercept": base, "error": seen[1], "baseline_error": seen[2], "explained": 1 - seen[3] / seen[4] if seen[4] else 0.0, "improvement": gain, "verdict": "useful" if gain >= BEATS else "weak"}


def naive_bayes(df: DataFrame, inputs: list[Column], label: Column, n: str | None = None) -> DataFrame:
    """label, prior (log), means, spreads (population variance, 0.001 at least): one row per class. Where ``n`` counts equal
    rows, the inputs are ``scaled``, so that sums of squares keep their digits."""
    everyone = Window.partitionBy()
    mean = lambda c: F.avg(c) if n is None else F.sum(F.col(n) * c) / F.sum(n)
    spread = lambda c: F.var_pop(c) if n is None else mean(c * c) - mean(c) ** 2
    rows = df.groupBy(label.alias("label")).agg(how_many(n).alias("n"), F.array(*[mean(c) for c in inputs]).alias("means"), F.array(*[F.greatest(spread(c), F.lit(LEAST_SPREAD)) for c in inputs]).alias("spreads"))
    return rows.withColumn("prior", F.ln(F.col("n") / F.sum("n").over(everyone))).select("label", "prior", "means", "spreads")


def classify(model: list[Any], inputs: list[Column]) -> Column:
    """The class of highest score, ties to the first by name: one expression for all classes."""
    scores = []
    for m in sorted(model, key=lambda r: str(r["label"])):
        s = F.lit(float(m["prior"]))
        for c, mean, spread in zip(inputs, m["means"], m["spreads"], strict=True):
            s = s - (c - F.lit(mean)) ** 2 / (2 * spread) - 0.5 * math.log(spread)
        scores.append((m["label"], s))
    best, value = F.lit(scores[0][0]), scores[0][1]
    for label, s in scores[1:]:
        best, value = F.when(s > value, F.lit(label)).otherwise(best), F.greatest(s, value)
    return best


def balanced_accuracy(pairs: DataFrame) -> DataFrame:
    """Of (actual, predicted), or of (actual, predicted, n) counted: the mean of each class's hit rate, 6 digits."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    each = pairs.groupBy("actual").agg((F.sum(F.when(F.col("actual") == F.col("predicted"), n).otherwise(0)) / F.sum(n)).alias("rate"))
    return each.agg(F.round(F.avg("rate"), 6).alias("balanced_accuracy"), F.count("*").alias("classes"))


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a double column, between two values by their distance, as ``percentile`` gives it.

    Equal values are counted by exchange and ranked by range, so that no task holds all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = settled(running_sums(counts, F.col("n").cast("decimal(20,0)"), "v", place="_place", total="upto").select("v", "upto"))
    n = upto.agg(F.max("upto")).first()[0]
    if n is None:
        return None
    at = (int(n) - 1) * share
    low, high = upto.agg(*[F.min(F.when(F.col("upto") > f(at), F.col("v"))) for f in (math.floor, math.ceil)]).first()
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def top_quarter(df: DataFrame, measure: str) -> Column:
    """'top' for the upper quarter of the training rows; rows without the measure stay unlabelled."""
    bar = quantile(df.where(~F.col("held_out")).select(F.col(f"`{measure}`").cast("double").alias("v")), "v", 0.75)
    return F.when(F.col(measure) >= bar, "top").when(F.col(measure).isNotNull(), "rest")


def classification(df: DataFrame, numbers: list[str], texts: list[str], label: str | None, measure: str | None = None, date: str | None = None, order: str = ROW) -> dict[str, Any]:
    """A card: balanced accuracy on held-out rows against the commonest class."""
    rows = split(df, date, order)
    inputs = Inputs.of(df, numbers, texts, order)
    rows = rows.where(inputs.complete())
    rows = rows.withColumn("_label", F.col(label).cast("string") if label else top_quarter(rows, measure)).where("_label is not null and _label <> ''")
    n, classes = rows.agg(F.count("*"), F.count_distinct("_label")).first()
    if n < LEAST_ROWS or not 2 <= classes <= MOST_CLASSES or not inputs.columns:
        return {"fitted": False, "rows": n, "classes": classes}
    train, test = rows.where(~F.col("held_out")), rows.where("held_out")
    x = scaled(train, inputs.columns)
    model = naive_bayes(train, x, F.col("_label")).collect()
    common = train.groupBy("_label").count().orderBy(F.desc("count"), "_label").first()[0]
    held = test.select(F.col("_label").alias("actual"), classify(model, x).alias("predicted"))
    score = balanced_accuracy(held).first()[0] or 0.0
    base = balanced_accuracy(held.withColumn("predicted", F.lit(common))).first()[0] or 0.0
    gain = improvement(score, base, False)
    return {"fitted": True, "rows": n, "classes": classes, "score": score, "baseline": base, "improvement": gain, "verdict": "useful" if gain >= BEATS else "weak"}


def silhouette(points: DataFrame) -> DataFrame:
    """Mean silhouette of all (group, vector) rows, by root mean square distances to a point's own and nearest group.

    A group's count, sums and sum of squares give every point's mean square distance to it, so the work is linear in the
    rows and no pair is made. One row per group, a few, is sent to all tasks."""
    squares = F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    width = points.select(F.size("vector").alias("k")).first()
    k = width["k"] if width else 0
    each = points.withColumn("squares", squares)
    groups = each.groupBy("group").agg(F.count("*").alias("m"), F.array(*[F.sum(F.get("vector", F.lit(i))) for i in range(k)]).alias("sums"), F.sum("squares").alias("total"))
    listed = groups.agg(F.collect_list(F.struct("group", "m", "sums", "total")).alias("groups"))

    def far(g: Column) -> Column:
        own = g["group"] == F.col("group")
        dot = F.aggregate(F.zip_with("vector", g["sums"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        others = g["m"] - F.when(own, 1).otherwise(0)
        # A point is no neighbour of itself; its distance to itself adds nothing to the sum.
        mean = F.try_divide(g["m"] * F.col("squares") - 2 * dot + g["total"], others.cast("double"))
        return F.struct(own.alias("own"), F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0)))).alias("d"))

    rows = each.crossJoin(F.broadcast(listed)).withColumn("far", F.transform("groups", far))  # one row of a few groups
    pick = lambda own: F.array_min(F.transform(F.filter("far", lambda x: x["own"] == own), lambda x: x["d"]))
    rows = rows.select(pick(True).alias("inside"), pick(False).alias("nearest"))
    score = F.when(F.col("inside").isNull() | F.col("nearest").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("nearest") - F.col("inside"), F.greatest("inside", "nearest")), F.lit(0.0)))
    return rows.agg(F.avg(score).alias("silhouette"))


def clusters(df: DataFrame, numbers: list[str], order: str = ROW, seed: int = 7, most: int = 5) -> dict[str, Any]:
    """k-means for k = 2 to 5 on scaled inputs; the best silhouette wins, the smaller k on a tie."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    inputs = [F.col(f"`{c}`").cast("double") for c in numbers[:MOST_NUMBERS]]
    rows = df.where(Inputs(list(numbers), inputs).complete())
    n = rows.count()
    if n < LEAST_ROWS:
        return {"fitted": False}
    rows = rows.select(order, F.array(*scaled(rows, inputs)).alias("vector"))
    if n > ROWS_A_TASK:  # a file may be one task, and every round reads what that task holds
        rows = rows.repartition(-(-n // ROWS_A_TASK), order)
    rows = rows.withColumn("features", array_to_vector("vector")).persist()
    best: tuple[float, int] | None = None
    for k in range(2, most + 1):
        found = KMeans(k=k, seed=seed + k, maxIter=60).fit(rows).transform(rows).withColumnRenamed("prediction", "group")
        score = silhouette(found.select("group", "vector")).first()[0] or 0.0
        if best is None or score > best[0] + 1e-12:
            best = (score, k)
    rows.unpersist()
    return {"fitted": True, "k": best[1], "silhouette": best[0], "verdict": "found" if best[0] >= SEPARATED else "weak"}


def seasonal_fit(series: np.ndarray, season: int, rounds: int = 8) -> tuple[float, float, np.ndarray]:
    """slope, intercept and centred season of one series (one number per period)."""
    x, pattern, slope, base = np.arange(len(series), dtype=float), np.zeros(season), 0.0, 0.0
    for _ in range(rounds):
        y = series - pattern[np.arange(len(series)) % season]
        slope, base = np.polyfit(x, y, 1) if len(series) > 1 else (0.0, float(y.mean()))
        rest = series - (base + slope * x)
        pattern = np.array([rest[i::season].mean() if len(rest[i::season]) else 0.0 for i in range(season)])
        pattern = pattern - pattern.mean()
    return float(slope), float(base), pattern


def seasonal_forecast(series: np.ndarray, season: int, steps: int) -> np.ndarray:
    slope, base, pattern = seasonal_fit(series, season)
    ahead = np.arange(len(series), len(series) + steps)
    return base + slope * ahead + pattern[ahead % season]


def seasonal(periods: DataFrame, grain: str) -> dict[str, Any]:
    """A card for one series: three seasons at least, the last held out, against the last period, the last season
    and the trend alone."""
    season = SEASONS.get(grain)
    series = np.array([r["total"] for r in periods.orderBy("label").select("total").collect()], float)
    if not season or len(series) < 3 * season:
        return {"fitted": False, "periods": len(series)}
    train, test = series[:-season], series[-season:]
    error = lambda guess: float(np.abs(guess - test).mean())
    slope, base = np.polyfit(np.arange(len(train)), train, 1)
    rivals = {"last period": error(np.full(season, train[-1])), "last season": error(train[-season:]), "trend only": error(base + slope * np.arange(len(train), len(series)))}
    rival = min(rivals, key=rivals.get)
    own = error(seasonal_forecast(train, season, season))
    gain = improvement(own, rivals[rival], True)
    return {"fitted": True, "season": season, "error": own, "baseline": rival, "baseline_error": rivals[rival], "improvement": gain, "verdict": "useful" if gain >= BEATS else "weak", "forecast": seasonal_forecast(series, season, season).tolist()}


def seasonal_many(df: DataFrame, key: str, season: int, steps: int) -> DataFrame:
    """(key, step, value) for many series of (key, label, total): each series is one group of a few hundred periods."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("label")["total"].to_numpy(float)
        ahead = seasonal_forecast(y, season, steps) if len(y) >= 3 * season else np.zeros(0)
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, len(ahead) + 1), "value": ahead})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "label", "total").groupBy(key).applyInPandas(one, f"`{key}` {kind}, step int, value double")
