"""One large file read by many tasks although its rows need not end where its bytes are cut.

A file comes in short pieces: lines of a CSV, stretches up to a closing brace of a JSON list. Whether a piece begins inside
quotes depends on all bytes before it, but what a piece does to that question is known from the piece alone: a function
from "inside or not" before it to the same after it. Such functions are composed within each span of the file, then over
the spans, so that every piece learns its true state; rows begin and end where the state says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import ROW, settled

SPAN = ["_file", "_from"]


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(value, _file, _from, _at): the file cut at each ``end``, which is left out; ``_from`` is the span's first byte."""
    cut = spark.read.option("lineSep", end).text(path)
    return cut.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"))


def _upto(*keys: str, order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _followed(df: DataFrame, window, outside: str, inside: str, start: Column, name: str) -> DataFrame:
    """``name``: the state after each row of ``window``, from ``start`` before its first. ``outside`` and ``inside`` are the
    states a row leads to from either one: a row that leads to one state from both settles it, one that swaps flips it."""
    flip = F.sum((F.col(outside) & ~F.col(inside)).cast("int")).over(window)
    rows = df.withColumn("_flips", flip)
    settled_at = F.last(F.when(F.col(outside) == F.col(inside), F.struct(F.col(outside).alias("is"), F.col("_flips").alias("at"))), ignorenulls=True).over(window)
    rows = rows.withColumn("_held", settled_at)
    since = F.when(F.col("_held").isNull(), F.col("_flips")).otherwise(F.col("_flips") - F.col("_held.at"))
    before = F.coalesce(F.col("_held.is"), start)
    return rows.withColumn(name, before != (since % 2 == 1)).drop("_flips", "_held")


def with_state(cut: DataFrame, outside: str, inside: str) -> DataFrame:
    """``cut`` with ``_was`` and ``_is``: whether each piece begins and ends inside quotes. A file begins outside."""
    window = _upto(*SPAN, order=["_at"])
    own = _followed(_followed(cut, window, outside, inside, F.lit(False), "_a"), window, outside, inside, F.lit(True), "_b")
    own = settled(own)
    spans = own.groupBy(*SPAN).agg(F.max_by("_a", "_at").alias("_a"), F.max_by("_b", "_at").alias("_b"))
    by_file = _upto("_file", order=["_from"])
    spans = _followed(spans, by_file, "_a", "_b", F.lit(False), "_end")
    begin = F.lag("_end", 1, False).over(Window.partitionBy("_file").orderBy("_from"))
    spans = spans.select(*SPAN, begin.alias("_begin"))
    rows = own.join(spans, SPAN).withColumn("_is", F.when(F.col("_begin"), F.col("_b")).otherwise(F.col("_a")))
    before = F.lag("_is", 1).over(Window.partitionBy(*SPAN).orderBy("_at"))
    return rows.withColumn("_was", F.coalesce(before, F.col("_begin"))).drop("_a", "_b", "_begin")


def numbered(rows: DataFrame, ends: Column, name: str = ROW) -> DataFrame:
    """``rows`` with the number of ends before each, over all files in their order."""
    rows = rows.withColumn("_ends", ends.cast("long"))
    own = F.sum("_ends").over(_upto(*SPAN, order=["_at"])) - F.col("_ends")
    spans = rows.groupBy(*SPAN).agg(F.sum("_ends").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*SPAN).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return rows.withColumn(name, own).join(spans.select(*SPAN, before.alias("_shift")), SPAN).withColumn(name, F.col(name) + F.col("_shift")).drop("_ends", "_shift")


def joined(rows: DataFrame, alone: Column, glue: str) -> DataFrame:
    """(_row_id, value): the pieces of each row in their order; pieces that are a row ``alone`` move nowhere."""
    rows = rows.withColumn("_alone", alone)
    parts = rows.where("NOT _alone").groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("_file", "_from", "_at", "value"))).alias("x"))
    return rows.where("_alone").select(ROW, "value").unionByName(parts.select(ROW, F.array_join(F.transform("x", lambda p: p["value"]), glue).alias("value")))


def _quotes(sep: str):
    """A function of lines to (outside leads to, inside leads to): a quote opens a cell only at the cell's start, and
    closes it unless another quote follows."""
    closing = re.compile('(?:[^"]|"")*"(?!")')

    def ends_inside(line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                done = closing.match(line, at)
                if not done:
                    return True
                at = done.end()
            elif line.startswith('"', at):
                inside, at = True, at + 1
                continue
            at = line.find(sep, at) + 1  # the rest of the cell is plain
            if not at:
                return False
            inside = False

    def leads(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lines = batch.to_pylist()
            both = [pa.array([bool(x is not None and ends_inside(x, s)) if x is not None else s for x in lines]) for s in (False, True)]
            yield pa.StructArray.from_arrays(both, names=["outside", "inside"])

    return F.arrow_udf(leads, T.StructType().add("outside", "boolean").add("inside", "boolean"))


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(_row_id, value): the text of each record of a UTF-8 CSV whose quoted cells may hold line ends."""
    cut = pieces(spark, path, "\n")
    marked = (F.col("_from") == 0) & F.startswith("value", F.lit("\ufeff"))
    cut = cut.withColumn("value", F.when(marked, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    # Lines without a quote lead nowhere else and need no look from Python.
    leads = _quotes(sep)(F.when(F.contains("value", F.lit('"')), F.col("value")))
    rows = with_state(cut.withColumn("_leads", leads).select("*", F.col("_leads.outside").alias("_out"), F.col("_leads.inside").alias("_in")).drop("_leads"), "_out", "_in")
    blank = ~F.col("_was") & ~F.col("_is") & ~F.col("value").rlike(r"\S")  # no record, as elsewhere
    records = joined(numbered(rows.where(~blank), ~F.col("_is")), ~F.col("_was") & ~F.col("_is"), "\n")
    returned = F.endswith("value", F.lit("\r"))
    return records.select(ROW, F.when(returned, F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value")).alias("value"))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(_row_id, value): the objects of a file that is one JSON list, each as text on one line.

    The file is cut at closing braces. Outside strings a brace or bracket changes the depth; an element ends with the
    brace that leads back to depth 1. What stands between objects but commas stays before the next one's text."""
    cut = pieces(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2 == 1
    cut = cut.select("*", plain.alias("_plain"), odd.alias("_out"), (~odd).alias("_in"))
    rows = with_state(cut, "_out", "_in")
    # From inside a string the text up to its closing quote goes first; then whole strings, then one left open.
    bare = F.when(F.col("_was"), F.regexp_replace("_plain", '^[^"]*+("|\\z)', "")).otherwise(F.col("_plain"))
    bare = F.regexp_replace(F.regexp_replace(bare, '"[^"]*+"', ""), '"[^"]*+\\z', "")
    count = lambda chars: F.length("_bare") - F.length(F.translate("_bare", chars, ""))
    rows = rows.withColumn("_bare", bare)
    rows = rows.withColumn("_step", count("{[") - count("]") - (~F.col("_is")).cast("int")).drop("_bare", "_plain")
    own = F.sum("_step").over(_upto(*SPAN, order=["_at"]))
    spans = rows.groupBy(*SPAN).agg(F.sum("_step").alias("_n"))
    before = F.sum("_n").over(_upto("_file", order=["_from"])) - F.col("_n")
    rows = rows.withColumn("_depth", own).join(spans.select(*SPAN, before.alias("_shift")), SPAN).withColumn("_depth", F.col("_depth") + F.col("_shift")).drop("_shift")
    ends = ~F.col("_is") & (F.col("_depth") == 1)
    rows = rows.where("_depth >= 0").withColumn("_ends_here", ends)  # behind a list's last object only its bracket is left
    rows = settled(numbered(rows, F.col("_ends_here")))
    after_end = F.lag("_ends_here", 1, False).over(Window.partitionBy(*SPAN).orderBy("_at"))  # a span's first piece is taken for no row alone
    found = joined(rows.withColumn("_after", after_end), F.col("_after") & F.col("_ends_here"), "}")
    text = F.concat(F.regexp_replace("value", r"^[\uFEFF\s\[,]*+", ""), F.lit("}"))
    return found.select(ROW, F.regexp_replace(text, r"[\r\n]+", " ").alias("value"))
