"""Sketches that grow, JSON cells as columns, a feed with look-back, and the detectors' budget."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import detectors, maintenance, semistructured, sketches
from plumbline.operators.table import ROW
from plumbline.streaming import live


def test_sketches_grow_to_the_same_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", rnd.randrange(2000), rnd.choice([rnd.lognormvariate(2, 2), -rnd.random() * 50, 0.0, None, float("nan")])) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long, x double").withColumn("i", F.monotonically_increasing_id())
    grown = sketches.Stored(spark, str(tmp_path / "grown"), ["g"], ["v"], ["x"])
    for k in range(3):
        grown.refresh(df.where(F.col("i") % 3 == k))
    whole = sketches.Stored(spark, str(tmp_path / "whole"), ["g"], ["v"], ["x"])
    whole.refresh(df)
    for name in ("distinct-v", "quantile-x"):
        a, b = grown.state(name), whole.state(name)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r for r in grown.quantiles("x", shares).collect()}
    counts = {r["g"]: r["distinct"] for r in grown.distinct_counts("v").collect()}
    for g in {r[0] for r in rows}:
        x = sorted(r[2] for r in rows if r[0] == g and r[2] is not None and not math.isnan(r[2]))
        for i, q in enumerate(shares):
            exact = x[max(0, math.ceil(len(x) * q) - 1)]
            assert found[g][f"q{i}"] == pytest.approx(exact, rel=sketches.ACCURACY * 1.001) and found[g]["n"] == len(x)
        true = len({r[1] for r in rows if r[0] == g})
        assert abs(counts[g] - true) <= max(2, 5 * 1.04 / 2 ** (sketches.BITS / 2) * true)
    none = sketches.Stored(spark, str(tmp_path / "none"), ["g"], ["v"], ["x"])
    none.refresh(df.limit(0))
    assert none.distinct_counts("v").count() == none.quantiles("x", [0.5]).count() == 0
    none.refresh(df)
    assert none.state("distinct-v").exceptAll(whole.state("distinct-v")).count() == 0


def test_json_cells(spark):
    cells = ['{"a": 1, "b": {"c": "x", "d": [1, 2]}, "it\'s": true}', '{"a": 2.5, "b": {"c": 7}}', "{broken", None, "[1]", '"text"', '{"b": null, "e.f": 3}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, cell string")
    found = dict(semistructured.discover(df, "cell"))
    assert {".".join(p) for p in found} >= {"a", "b.c", "b.d"} if found else True
    objects = df.where("cell LIKE '{%'")
    found = dict(semistructured.discover(objects, "cell"))
    assert found == {("a",): "double", ("b", "c"): "string", ("b", "d"): "string", ("it's",): "boolean", ("e.f",): "bigint"}
    rows = {r["i"]: r for r in semistructured.typed(df, "cell", list(found.items())).collect()}
    assert (rows[0]["cell.a"], rows[1]["cell.a"], rows[0]["cell.b.c"], rows[0]["cell.it's"], rows[6]["cell.e.f"]) == (1.0, 2.5, "x", True, 3)
    assert json.loads(rows[0]["cell.b.d"]) == [1, 2] and [rows[i]["cell.malformed"] for i in (0, 2, 3, 4)] == [False, True, False, False]
    told = {r["path"]: r for r in semistructured.paths(objects, "cell").collect()}
    assert (told["a"]["filled"], told["b.c"]["filled"], told["a"]["malformed"], told["a"]["records"]) == (2, 2, 1, 4)
    assert semistructured.paths(df.limit(0), "cell").count() == 0 and semistructured.typed(df.limit(0), "cell").columns == ["i", "cell", "cell.malformed"]
    with pytest.raises(ValueError, match="cell.malformed"):
        semistructured.typed(df.withColumn("cell.malformed", F.lit(1)), "cell", [])


def test_feed_sends_each_update_once(spark, tmp_path):
    rnd = random.Random(8)
    # Few different seconds, so that page borders fall between updates of one time; each update stands twice.
    rows = [(f"2025-01-01 00:00:{rnd.randrange(8):02d}", rnd.choice(["run", "source"]), i) for i in range(60)]
    make = lambda some: spark.createDataFrame(some * 2, "t string, kind string, id int").withColumn("t", F.to_timestamp("t"))
    late, there = rows[:12], rows[12:]
    feed = live.Feed(spark, str(tmp_path / "feed"), "t", "kind", "id", "20 SECONDS", most=7)
    feed.start(make(there), "2025-01-01 00:00:00~~")
    sent = []

    def drain(df):
        while True:
            page = [(r["t"], r["kind"], str(r["id"])) for r in feed.poll(df).collect()]
            assert page == [(r["t"], r["kind"], str(r["id"])) for r in feed.poll(df).collect()]  # until it is committed
            assert page == sorted(page) and len(page) <= 7
            sent.extend(page)
            if not feed.commit():
                return

    drain(make(there))
    assert sorted(x[2] for x in sent) == sorted(str(r[2]) for r in there)
    again = live.Feed(spark, str(tmp_path / "feed"), "t", "kind", "id", "20 SECONDS", most=7)
    again.generation = feed.generation  # another worker goes on from the state
    feed = again
    drain(make(rows))
    assert sorted(x[2] for x in sent) == sorted(str(r[2]) for r in rows)
    assert feed.poll(make([("2024-12-31 23:00:00", "run", 99)])).count() == 0  # later than the look-back allows


def test_feed_starts_after_what_is_there_and_forgets(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "t string, kind string, id int").withColumn("t", F.to_timestamp("t"))
    old = [("2025-01-01 00:00:01", "run", 1), ("2025-01-01 00:00:02", "run", 2)]
    feed = live.Feed(spark, str(tmp_path / "f"), "t", "kind", "id", "5 SECONDS")
    feed.start(make(old))
    assert feed.poll(make(old)).count() == 0 and feed.commit() == 0
    new = [*old, ("2025-01-01 00:00:02", "run", 3), ("2025-01-01 01:00:00", "run", 4)]
    assert [r["id"] for r in feed.poll(make(new)).collect()] == [3, 4]
    assert feed.commit() == 2
    assert feed._state().where("NOT cursor").count() == 1  # what is older than the look-back is forgotten


def wide(spark, n):
    names = [f"cost_{i}" for i in range(n)]
    return spark.range(30).select(F.col("id").alias(ROW), *[(F.col("id") * (i + 1) + 0.5).cast("string").alias(c) for i, c in enumerate(names)])


def test_wide_tables_skip_detectors_by_name(spark):
    s = detectors.Shape.of(wide(spark, 200))
    assert len(s.numeric()) == 200 and detectors.candidates(s)["broken_identity"] == 200 * 199 * 198 // 2
    told = detectors.skipped(s)
    assert [f.numbers["detector"] for f in told] == ["broken_identity"] and "3940200 candidates" in told[0].headline
    found = detectors.run_all(wide(spark, 25), ROW, most=100)
    assert [(f.detector, f.numbers.get("detector")) for f in found if f.detector == "skipped"] == [("skipped", "broken_identity")]
    barred = maintenance.govern(wide(spark, 5), ROW, most_cells=10)
    assert {f.numbers["detector"] for f in barred if f.detector == "skipped"} == {"broken_identity", "target_leakage"}


def test_budget_leaves_findings_alone(spark):
    rows = spark.range(100).select(F.col("id").alias(ROW), F.col("id").cast("string").alias("parts_cost"), (F.col("id") * 2).cast("string").alias("labour_cost"), (F.col("id") * 3.5 + 1).cast("string").alias("repair_cost"))
    assert [f.columns for f in detectors.run_all(rows, ROW) if f.detector == "broken_identity"] == [["repair_cost", "parts_cost", "labour_cost"]]


def test_feed_gives_all_pages_in_one_pass(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"2025-01-01 00:00:{rnd.randrange(8):02d}", rnd.choice(["run", "source"]), i) for i in range(60)]
    make = lambda some: spark.createDataFrame(some * 2, "t string, kind string, id int").withColumn("t", F.to_timestamp("t"))
    feeds = [live.Feed(spark, str(tmp_path / name), "t", "kind", "id", "5 SECONDS", most=7) for name in ("polled", "whole")]
    for feed in feeds:
        feed.start(make(rows[20:]), "2025-01-01 00:00:00~~")
    state = lambda feed: sorted((str(r["place"]), r["cursor"]) for r in feed._state().collect())
    key = lambda r: (r["t"], r["kind"], str(r["id"]))
    for there in (rows[20:], rows, rows):  # the second time some are late, the third time nothing is new
        polled, whole = [], {}
        while page := [key(r) for r in feeds[0].poll(make(there)).collect()]:
            polled.append(page)
            feeds[0].commit()
        for r in feeds[1].pages(make(there)).collect():
            whole.setdefault(r["page"], []).append(key(r))
        assert [sorted(whole[i]) for i in sorted(whole)] == polled and sorted(whole) == list(range(len(polled)))
        assert feeds[1].commit() == sum(map(len, polled))
        assert state(feeds[0]) == state(feeds[1])


def test_the_number_of_pages_does_not_multiply_jobs(spark, tmp_path):
    def jobs(most):
        feed = live.Feed(spark, str(tmp_path / f"n{most}"), "t", "kind", "id", "1 DAY", most=most)
        df = spark.range(300).select(F.timestamp_seconds("id").alias("t"), F.lit("run").alias("kind"), "id")
        feed.start(df, "1970-01-01 00:00:00~~")
        spark.sparkContext.setJobGroup(f"most{most}", "")
        assert feed.pages(df).agg(F.max("page")).first()[0] == -(-300 // most) - 1 and feed.commit() == 300
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"most{most}"))

    assert jobs(3) == jobs(300)
