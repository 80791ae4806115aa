"""Joins by time, frames by value range, states of a table compared, and both-sided accounts: brute force and hot keys."""

import datetime as dt
import random
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import changes, temporal


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables keep their ranges, so that one key fills several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def moments(n, users, seed, hot=0.4):
    """(id, user, second, mark): a third of all rows and more with one user, few different seconds, nulls."""
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < 0.03 else 0 if rnd.random() < hot else rnd.randrange(users), None if rnd.random() < 0.03 else rnd.randrange(max(4, n // 4)), rnd.choice("abc")) for i in range(n)]


KIND = "id long, user int, at long, mark string"


@pytest.fixture(scope="module", params=[0.4, 1.0])
def sides(spark, request):
    left, right = moments(600, 7, 1, request.param), moments(400, 9, 2, request.param)
    return left, right, spark.createDataFrame(left, KIND).repartition(5), spark.createDataFrame(right, KIND).repartition(3)


@pytest.mark.parametrize(("strict", "forward", "tolerance"), [(False, False, None), (True, False, None), (False, True, None), (True, True, 5), (False, False, 3)])
def test_asof_against_search(spark, sides, strict, forward, tolerance):
    left, right, l_df, r_df = sides
    got = temporal.asof(l_df, r_df, ["user"], "at", ties=["id"], strict=strict, forward=forward, tolerance=tolerance).collect()
    by_user = {}
    for i, user, at, _ in right:
        if user is not None and at is not None:
            by_user.setdefault(user, []).append((-at if forward else at, i))
    for own in by_user.values():
        own.sort()
    want = {}
    for i, user, at, _ in left:
        own, t = by_user.get(user, []), None if at is None else -at if forward else at
        k = 0 if t is None else bisect_left(own, (t,)) if strict else bisect_right(own, (t, 10**9))
        found = own[k - 1] if k else None
        want[i] = found[1] if found and (tolerance is None or t - found[0] <= tolerance) else None
    assert len(got) == len(left)
    assert {r["id"]: r["last_id"] for r in got} == want
    marks = {i: m for i, _, _, m in right}
    assert all(r["last_mark"] == (marks[r["last_id"]] if r["last_id"] is not None else None) for r in got)


def test_asof_spreads_a_hot_key(spark):
    rows = spark.range(4000).select(F.lit(1).alias("user"), F.col("id").alias("at"), "id")
    dealt = temporal.ranged(rows, F.col("user"), F.col("at"))
    assert dealt.select("_part").distinct().count() > 1
    got = temporal.asof(rows, rows, ["user"], "at", strict=True)
    assert got.where("last_id = id - 1").count() == 3999 and got.where("last_id IS NULL").count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_asof_kinds_and_names(spark):
    left = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12), "x")], "id int, ts timestamp, last_v string")
    right = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 11), 5), (1, dt.datetime(2024, 1, 1, 13), 6)], "id int, ts timestamp, v int")
    got = temporal.asof(left, right, ["id"], "ts")
    assert got.columns == ["id", "ts", "last_v", "last_id", "last_ts", "last_v_2"] and got.first()["last_v_2"] == 5
    assert temporal.asof(left.limit(0), right, ["id"], "ts").count() == 0
    assert temporal.asof(left, right.limit(0), ["id"], "ts").first()["last_v_2"] is None
    with pytest.raises(TypeError):
        temporal.asof(left, right.withColumn("ts", F.lit("x")), ["id"], "ts")


@pytest.mark.parametrize(("lower", "upper"), [(0, 3), (-2, 2), (-5, -1), (0, 0)])
def test_interval_join_against_all_pairs(sides, lower, upper):
    left, right, l_df, r_df = sides
    want = sorted((a[0], b[0]) for a in left for b in right if None not in (a[1], a[2], b[2]) and a[1] == b[1] and lower <= b[2] - a[2] <= upper)
    made = temporal.interval_join(l_df, r_df, ["user"], "at", lower, upper)
    assert sorted((r["id"], r["near_id"]) for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    hit = {a for a, _ in want}
    assert {r["id"] for r in temporal.interval_join(l_df, r_df, ["user"], "at", lower, upper, how="semi").collect()} == hit
    assert sorted(r["id"] for r in temporal.interval_join(l_df, r_df, ["user"], "at", lower, upper, how="anti").collect()) == sorted(a[0] for a in left if a[0] not in hit)
    outer = temporal.interval_join(l_df, r_df, ["user"], "at", lower, upper, how="left").collect()
    assert sorted((r["id"], r["near_id"]) for r in outer if r["near_id"] is not None) == want and {r["id"] for r in outer} == {a[0] for a in left}


def test_frames_against_all_rows(spark, sides):
    left, _, l_df, _ = sides
    got = temporal.range_frames(l_df, ["user"], "at", 10, {"n": F.count("*"), "ids": F.sum("id")}, per_bin=2).collect()
    for r in got:
        own = [x[0] for x in left if x[1] == r["user"] and r["at"] is not None and x[2] is not None and 0 <= r["at"] - x[2] <= 10]
        assert (r["n"], r["ids"]) == ((len(own), sum(own)) if r["at"] is not None else (None, None))
    assert len(got) == len(left)
    bins = l_df.where("user = 0 and at is not null").select(F.floor(F.col("at") / 20)).distinct().count()
    assert bins > 3  # the hot user is cut


def test_changes_and_back(spark):
    rnd = random.Random(3)
    kind = "a int, b string, c array<int>, d map<string,int>"
    make = lambda n: [(rnd.choice([1, 2, None]), rnd.choice(["x", "", None]), rnd.choice([[1], [], None]), rnd.choice([{"k": 1, "j": 2}, {}, None])) for _ in range(n)]
    for one, two in ((make(200), make(220)), (make(50), []), ([], make(5)), (make(5) * 2, make(1))):
        before, after = spark.createDataFrame(one, kind), spark.createDataFrame(two, kind)
        found = changes.changes(before, after)
        tell = lambda r: repr((r[0], r[1], r[2], sorted(r[3].items()) if r[3] is not None else None))
        p, q = Counter(map(tell, one)), Counter(map(tell, two))
        got = {tell(r): (r["n_before"], r["n_after"]) for r in found.collect()}
        assert got == {k: (p[k], q[k]) for k in p | q if p[k] != q[k]}
        assert Counter(map(tell, changes.applied(before, found).collect())) == q
    assert changes.changes(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1,)], "a int")).count() == 2
    with pytest.raises(ValueError, match="n_after"):
        changes.changes(spark.createDataFrame([(1,)], "n_after int"), spark.createDataFrame([(1,)], "n_after int"))


def test_nulls_that_stand_elsewhere_are_changes(spark):
    kind = "a string, b string"
    found = changes.changes(spark.createDataFrame([(None, "x")], kind), spark.createDataFrame([("x", None)], kind))
    assert sorted(r["change"] for r in found.collect()) == ["added", "removed"]


def test_reconcile(spark):
    left = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (None, 1.0)] + [(7, 1.0)] * 500, "k int, v double")
    right = spark.createDataFrame([(1, 4.5), (3, 1.0), (None, 2.0)], "key int, w double")
    got = {r["k"]: r.asDict() for r in changes.reconcile(left, right, [("k", "key")], [("v", "w")]).collect()}
    assert {k: r["side"] for k, r in got.items()} == {1: "both", 2: "left", 3: "right", None: "both", 7: "left"}
    assert (got[1]["n_left"], got[1]["v_left"], got[1]["v_right"], got[1]["v_apart"]) == (2, 5.0, 4.5, 0.5) and got[7]["n_left"] == 500
    told = {r["side"]: r for r in changes.accounts(changes.reconcile(left, right, [("k", "key")], [("v", "w")])).collect()}
    assert (told["left"]["keys"], told["left"]["n_left"], told["right"]["n_right"], told["both"]["v_left"]) == (2, 501, 1, 6.0)
