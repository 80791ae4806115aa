"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling.

The lines of a document that hold a word, trimmed, are a sequence of line ids. Every position starts a suffix of
its sequence. A rank is a suffix's place in the order of all suffixes by their first ``depth`` lines. Doubling takes
the pair of a suffix's rank and the rank ``depth`` lines on; the pairs that occur twice or more are counted, sorted by
range partitioning and numbered in that order, and the numbers are the ranks at twice the depth. A rank held once, and
one whose pair reaches a place without a rank, leaves, so each round has the repeated suffixes alone, and the rounds end
when all ranks are single.

Suffixes of one rank are an interval of the suffix array whose common prefix is at least the depth. Depths from
``min_lines`` on (two ranks that overlap cover a depth that is no power of two) make it a repeated run: its first place,
by doc_id and line, stays, and every other is a later place of that length. Later places that meet or overlap within a
document are one maximal repeated run, and its lines are deleted. Runs are judged on the input: of lines that repeat
back to back, what comes before the second place stays.

With ``min_words`` an interval of fewer lines is a run too if it has that many words; every depth up to ``min_lines``
is then visited.

Defined cases: null text has no lines; lines without a word are never part of a run and stay; a run may repeat
within one document; null doc_ids come first; ids are integers, others are refused; rows equal in doc_id and text are
one document, whose copies get the same verdict; extra columns pass through whatever their names, and result columns
replace columns of their name; very long texts are lines like any other's, an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import integer_id, materialize, packed, unpacked, word_count

RESULT = ["n_lines", "n_removed", "n_runs", "kept_text"]
KEY = ["_id", "_text"]
_SPACE = " \t\n\x0b\x0c\r"


def keys_of(docs: DataFrame) -> list[Column]:
    integer_id(docs, "doc_id")
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(docs["text"]).alias("_text")]


def has_word(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")) > 0


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sequence_of(docs: DataFrame, by_words: bool) -> DataFrame:
    """_id, _text, at (counts lines with a word from 0), the line's id a, b (128 bits), and its words if asked for."""
    lines = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.trim(x, F.lit(_SPACE))), lambda x: F.length(x) > 0)
    rows = docs.select(*KEY, F.posexplode(lines).alias("at", "line"))
    words = [word_count(F.col("line")).alias("words")] if by_words else []
    return rows.select(*KEY, "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), *words)


def classes_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, rank and first (the least place) of every value of ``by`` that occurs twice or more.

    Counts and minima are partial sums before the shuffle. Range partitions in order, sorted within, make Spark's own
    row number an order-preserving rank; it is written, so that it is the same for every reader."""
    place = F.struct(F.col("_id"), F.col("at"), F.col("_text"))
    seen = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return materialize(seen.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("new_rank", F.monotonically_increasing_id()), "line-classes")


def ranked(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """The suffixes that have a class, with their rank and whether they are a later place of it. The classes are unique,
    so the rows of a hot one can be split over tasks."""
    place = F.struct(F.col("_id"), F.col("at"), F.col("_text"))
    kept = [c for c in rows.columns if c not in (*by, "words")]
    held = rows.join(classes, by).withColumn("later", place != F.col("first"))
    return materialize(held.select(*kept, *(["words"] if "words" in rows.columns else []), F.col("new_rank").alias("rank"), "later"), "line-ranks")


def later_places(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """(_id, _text, at, lines): suffixes whose first ``lines`` lines also stand at an earlier place, at every depth
    that the doubling visits. ``docs`` has _id, _text and text."""
    by_words = min_words is not None
    # ``words`` of the line itself, ``total`` of all lines at the depth.
    rows = sequence_of(docs, by_words).distinct()
    if by_words:
        rows = rows.withColumn("total", F.col("words"))
    now, depth, found = ranked(rows, classes_of(rows, ["a", "b"]), ["a", "b"]), 1, []
    while True:
        if depth >= min_lines or by_words:
            long = F.lit(True) if depth >= min_lines else F.col("total") >= min_words
            found.append(now.where(F.col("later") & long).select(*KEY, "at", F.lit(depth).alias("lines")))
        step = depth if depth >= min_lines else 1 if by_words else min(depth, min_lines - depth)
        ahead = now.select(*KEY, (F.col("at") - step).alias("at"), F.col("rank").alias("other"), *([F.col("total").alias("other_total")] if by_words else []))
        pairs = now.drop("later").join(ahead, [*KEY, "at"])
        if by_words:
            total = F.when(F.lit(step == 1), F.col("words") + F.col("other_total")).otherwise(F.col("total") + F.col("other_total"))
            pairs = pairs.withColumn("total", total).drop("other_total")
        classes = classes_of(pairs, ["rank", "other"])
        if not classes.head(1):
            break
        now, depth = ranked(pairs, classes, ["rank", "other"]), depth + step
    out = found[0] if found else now.select(*KEY, "at", F.lit(0).alias("lines")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def maximal_runs(later: DataFrame) -> DataFrame:
    """_id, _text, runs: the places from and to (exclusive) of each run of lines to delete, from first to last. Later
    places of a document are as many as its lines at most, at each depth."""
    by = Window.partitionBy(*KEY).orderBy("at", "lines")
    before = F.max(F.col("at") + F.col("lines")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("starts", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("lines")).alias("to"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def dedup(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``docs`` with n_lines, n_removed, n_runs (maximal deleted runs) and kept_text."""
    rows, own = packed(docs, *keys_of(docs), docs["text"].alias("text"), without=[*RESULT, "text"])
    gone = maximal_runs(later_places(docs.select(*keys_of(docs), "text"), min_lines, min_words))
    both = rows.join(gone, KEY, "left")
    lines = F.filter(lines_of(F.col("text")), has_word)
    runs = F.coalesce("runs", F.array().cast("array<struct<from:int,to:int>>"))
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return both.select(*unpacked(own), "text", F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"), F.size(runs).cast("long").alias("n_runs"), F.arrow_udf(_without, T.StringType())("text", "runs").alias("kept_text")).select(*[f"`{c}`" for c in docs.columns if c not in RESULT], *RESULT)


def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    """Each text without the runs of lines listed; the places count lines with a word only."""
    out = []
    for t, runs in zip(text, removed, strict=True):
        gone = {i for r in runs.as_py() or () for i in range(r["from"], r["to"])}
        if not gone:
            out.append(t.as_py() or "")
            continue
        kept, at = [], 0
        for line in t.as_py().split("\n"):
            word = bool(line.strip(_SPACE))
            if not (word and at in gone):
                kept.append(line)
            at += word
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def oracle(min_lines: int) -> str:
    """The same in DuckDB's SQL: whole windows of lines are compared."""
    return rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS no FROM split),
worded AS (SELECT doc_id, no, trim(line, E' 	

') AS line FROM lines WHERE trim(line, E' 	

') <> ''),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos FROM worded),
wins AS (SELECT doc_id, pos, {", ".join(f"lead(line, {k}) OVER w AS l{k}" for k in range(min_lines))} FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
nth AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY {", ".join(f"l{k}" for k in range(min_lines))} ORDER BY doc_id, pos) AS n FROM wins WHERE l{min_lines - 1} IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM nth, range(0, {min_lines}) t(k) WHERE n > 1),
marked AS (SELECT l.doc_id, l.no, l.line, s.pos, g.pos IS NOT NULL AS gone, g.pos IS NOT NULL AND p.pos IS NULL AS starts
  FROM lines l LEFT JOIN seq s USING (doc_id, no) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos LEFT JOIN gone p ON p.doc_id = s.doc_id AND p.pos = s.pos - 1)
SELECT doc_id, count(pos) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
  md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5 FROM marked GROUP BY doc_id
"""
