"""Quality rules with adaptive thresholds.

Each document's features are measured once. For every (language, source) a mergeable quantile sketch of each
ratio is kept: counts of logarithmic buckets, two of which merge by adding, so partial sketches meet in an
ordinary aggregation. Documents that fail the base rules are in no sketch. A fence at the upper quartile plus
``reach`` times the distance from the median to it is read from each sketch, joined back to the features, and a
document beyond any fence goes. Junk that makes up less than a quarter of a group reaches neither quantile. No
fixed cutoff and no fixed share of rejects is involved: what is usual for a group stays.

The distance is at least what the group can tell apart: one bucket's width at the quartile, and one event (a symbol,
a repeated line, a window of words that comes twice) in the group's median document, whose words and lines are
sketched too. Where half of a group's documents have one line, its fence on repeated lines is thus beyond any ratio.
A group's fences are drawn to those of its language's merged sketch as if ``PRIOR_DOCS`` documents of the language stood
in the group: those of n documents weigh n / (n + PRIOR_DOCS). So no count of documents is a border between two rules.

Defined cases: null text counts as no words and fails the base rules; null language or source is a group of its
own; a language of a few documents has the fences of its few documents; repeated rows are judged alike and each
counts in the sketch; very long texts are measured whole, one at a time; an empty table gives an empty result; ids may be
of any type. Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = b"#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
#: Ratio by name: its columns, and what one event adds to the first of them.
RATIOS = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 6), "word_length": ("word_chars", "n_words", 0)}
#: Documents whose weight a language's fences have in each of its groups.
PRIOR_DOCS = 100
_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The features of one whole text, in the order of FEATURES."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(data.count, (bytes([b]) for b in _SPACE)))
    symbols = sum(map(data.count, (bytes([b]) for b in SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    covered = 0
    if len(counts) < len(windows):
        end = 0  # first word that is not covered yet
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), covered


def features(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keys`` and the features of each document; only the keys and the text are read."""
    schema = docs.select(*keys).schema
    for name in FEATURES:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))]], names=[*keys, *FEATURES])

    return docs.select(*keys, "text").mapInArrow(run, schema)


def bucket(value: Column, per_doubling: int = 16) -> Column:
    """The sketch's bucket of a non-negative ratio: 0 for 0, else logarithmic with 2**(1/16) between bounds."""
    return F.when(value <= 0, F.lit(-100000)).otherwise(F.floor(F.log2(value) * per_doubling)).cast("int")


def bound(number: Column, per_doubling: int = 16) -> Column:
    """The upper bound of a bucket."""
    return F.when(number == -100000, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (number + 1) / F.lit(float(per_doubling))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): mergeable, since n adds up over any split of the rows."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(F.coalesce(F.try_divide(a, b), F.lit(0.0))).alias("bucket")) for k, (a, b, _) in RATIOS.items()], *[F.struct(F.lit(k).alias("ratio"), bucket(F.col(k)).alias("bucket")) for k in ("n_words", "n_lines")])).alias("x")
    return measured.where(~base_failed()).select("lang", "source", named).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def read(sketch: DataFrame, by: list[str], reach: float) -> DataFrame:
    """One row per ``by`` with its documents and the fence of each ratio."""
    group = Window.partitionBy(*by, "ratio")
    upto = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    quantile = lambda q: bound(F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bucket"))))
    found = upto.groupBy(*by, "ratio").agg(quantile(0.5).alias("q50"), quantile(0.75).alias("q75"), F.max("all").alias("docs"))
    of = lambda k, q: F.max(F.when(F.col("ratio") == k, F.col(q)))
    apart = lambda k, per, event: F.greatest(of(k, "q75") - of(k, "q50"), of(k, "q75") * (1 - 2 ** (-1 / 16)), event / of(per, "q50"))
    return found.groupBy(*by).agg(F.max("docs").alias("docs"), *[(of(k, "q75") + reach * apart(k, per, event)).alias(f"max_{k}") for k, (_, per, event) in RATIOS.items()])


def fences(sketch: DataFrame, reach: float = 4.0) -> DataFrame:
    """One row per (lang, source) with the fence of each ratio; a group's sketch has a few hundred buckets at most."""
    own = read(sketch, ["lang", "source"], reach).alias("own")
    merged = sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    wide = read(merged, ["lang"], reach).alias("wide")
    drawn = lambda k: (F.col("own.docs") * F.col(f"own.{k}") + PRIOR_DOCS * F.col(f"wide.{k}")) / (F.col("own.docs") + PRIOR_DOCS)
    both = own.join(wide, F.col("own.lang").eqNullSafe(F.col("wide.lang")))
    return both.select("own.lang", "own.source", *[drawn(f"max_{k}").alias(f"max_{k}") for k in RATIOS])


def judge(docs: DataFrame, reach: float = 4.0) -> DataFrame:
    """doc_id, lang, source, the features, the group's fences, base_failed and kept."""
    measured = materialize(features(docs), "quality-features")
    limits = fences(sketches(measured), reach)
    both = measured.withColumn("base_failed", base_failed()).alias("m").join(limits.alias("f"), F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    within = F.lit(True)
    for k, (a, b, _) in RATIOS.items():
        within = within & (F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) <= F.col(f"max_{k}"))
    return both.select("m.*", *[f"max_{k}" for k in RATIOS], (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))
