import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import analysis, clean, detectors, experiments, governance, joins, maintenance, models
from plumbline.operators.table import ROW, AnalysisTable


def frame(spark, columns, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + f", {ROW} long")


# ---- joins


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for m in range(6):
        for p in range(1, 5):
            rows.append((f"2025-0{m + 1}", f"P{p}", "South" if m % 2 == 0 else "North", float(100 + 10 * m + 5 * p), len(rows)))
    return AnalysisTable(spark.createDataFrame(rows, f"month string, product string, region string, revenue double, {ROW} long"), frozenset({"revenue"}))


def products(spark):
    return joins.Lookup(spark.createDataFrame([("P1", "Hardware", 10.0), ("P2", "Software", 20.0), ("P3", "Hardware", 15.0), ("P9", "Services", 5.0)], "code string, category string, list_price double"), frozenset({"list_price"}))


def test_left_join_keeps_the_total(spark, sales):
    m = joins.merge(sales, [products(spark)], [joins.Join((("product", "code"),), name="Products.csv")])
    (s,) = m.stats
    assert (s["rows_in"], s["rows_out"], s["matched"], s["unmatched"], s["coverage"], s["lookup_unused"]) == (24, 24, 18, 6, 0.75, 1)
    assert m.table.df.agg(F.sum("revenue")).first()[0] == sales.df.agg(F.sum("revenue")).first()[0]
    lone = m.table.df.where("product = 'P4'").select("category", "list_price").distinct().collect()
    assert [tuple(r) for r in lone] == [("", None)]


def test_inner_join(spark, sales):
    assert joins.merge(sales, [products(spark)], [joins.Join((("product", "code"),), "inner")]).table.df.count() == 18


def test_repeated_key_is_refused(spark, sales):
    look = joins.Lookup(spark.createDataFrame([("P1", "a"), ("P1", "b")], "code string, category string"), frozenset())
    with pytest.raises(joins.JoinError, match="repeats its key: P1"):
        joins.merge(sales, [look], [joins.Join((("product", "code"),))])


def test_date_key(spark, sales):
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun"]
    look = joins.Lookup(spark.createDataFrame([(f"{n} 2025", 1000.0 + 100 * i) for i, n in enumerate(names)], "month string, target double"), frozenset({"target"}))
    t, stats = joins.join_one(sales, look, joins.Join((("month", "month"),)), "targets", "month", "month")
    assert stats.first()["matched"] == 24 and t.df.where("month = '2025-03'").select("target").distinct().first()[0] == 1200.0


def test_rename_and_alias():
    assert joins.default_alias("Regional Targets.xlsx") == "regional_targets" and joins.default_alias("2024.csv") == "joined_2024"
    assert joins.rename(["a", "b"], ["k", "a", "c"], {"k"}, "x") == {"a": "x.a", "c": "c"}
    assert joins.assign_aliases([joins.Join((), name="a.csv"), joins.Join((), name="a.csv")]) == ["a", "a_2"]
    with pytest.raises(joins.JoinError) as e:
        joins.normalise([{"keys": [], "how": "outer"}])
    assert len(e.value.problems) == 2


def test_lookup_cleaning(spark):
    rows = [("P1", " 10 "), ("P1", "10"), ("", ""), ("P2", "x"), ("P3", "3"), ("P4", "4")]
    look = joins.clean_lookup(frame(spark, ["code", "price"], rows))
    assert (look.rows_before, look.empty, look.duplicates, look.df.count()) == (6, 1, 1, 4)
    assert look.numeric == frozenset()


def test_join_is_broadcast_when_small(spark, sales):
    t, _ = joins.join_one(sales, products(spark), joins.Join((("product", "code"),)), "p", check=False)
    t.df.collect()
    assert "BroadcastHashJoin" in t.df._jdf.queryExecution().executedPlan().toString()


# ---- cleaning and mapping

SHOP = [(str(i), f"{13 + i % 5}/0{1 + i % 3}/2025" if i else "sometime", f"S{i % 3}", "North" if i % 2 else "South", "$1,200" if i % 3 else "(200)", f"note {i}") for i in range(12)]
COLUMNS = ["row_id", "order_date", "store_id", "region", "amount", "notes"]
MAPPING = clean.Mapping({"order_date": "date", "store_id": "dimension", "region": "dimension", "amount": "measure", "row_id": "ignore", "notes": "ignore"}, "amount", "region", "auto", "month")


def test_clean_with_mapping(spark):
    done = clean.clean(frame(spark, COLUMNS, SHOP), MAPPING)
    assert (done.rows_before, done.rows_after, done.grain, done.order) == (12, 12, "month", "day-first")
    assert done.dates_unreadable == 1
    assert done.table.df.agg(F.sum("amount")).first()[0] == 8 * 1200 - 4 * 200


def test_validate(spark):
    df = frame(spark, COLUMNS, SHOP)
    assert clean.validate(df, MAPPING).roles == {c: MAPPING.roles[c] for c in COLUMNS}
    with pytest.raises(clean.MappingError) as e:
        clean.validate(df, clean.Mapping({"order_date": "date", "notes": "measure", "amount": "date", "zzz": "ignore"}, "amount", "region"))
    assert len(e.value.problems) >= 6


def test_suggest(spark):
    mapping, why = clean.suggest(frame(spark, COLUMNS, SHOP))
    assert mapping.roles["order_date"] == "date" and mapping.roles["amount"] == "measure" and mapping.roles["region"] == "dimension"
    assert why["row_id"] == "identifier" and mapping.measure == "amount"


def test_first_duplicate_wins(spark):
    rows = clean.without_repeats(clean.trimmed(frame(spark, ["a"], [("x ",), ("x",), ("y",)]))).orderBy(ROW).collect()
    assert [(r["a"], r[ROW]) for r in rows] == [("x", 0), ("y", 2)]


def test_personal_columns(spark):
    rows = [(f"p{i}@mail.com", ["visa", "master"][i % 2], str(i * 3), f"{['Ann', 'Bob', 'Cid'][i % 3]} {chr(65 + i)}oe") for i in range(12)]
    got = {r["name"] for r in clean.personal_columns(frame(spark, ["contact", "card_type", "email_opens", "full_name"], rows)).collect()}
    assert got == {"contact", "full_name"}


def test_every_kth_row(spark):
    df = spark.range(1000).select(F.col("id").alias(ROW))
    got = [r[0] for r in clean.sample(df, 300).orderBy(ROW).collect()]
    assert got == [int(i * 1000 / 300) for i in range(300)]


# ---- analytics


@pytest.fixture(scope="module")
def linear(spark):
    rows = [(f"2025-0{i + 1}", t, s, 2 * i + j) for i in range(6) for j, (t, s) in enumerate((("Alpha", 100.0 + 10 * i), ("Beta", 50.0)))]
    return spark.createDataFrame(rows, f"month string, team string, sales double, {ROW} long")


def test_linear_series(linear):
    p = analysis.trend(linear, "sales", F.col("month"))
    f = analysis.fit(p).first()
    assert (round(f["slope"], 6), round(f["explained"], 6)) == (10.0, 1.0)
    rows = analysis.labelled_forecast(p).orderBy("step").collect()
    assert [(r["label"], r["value"]) for r in rows] == [("2025-07", 210.0), ("2025-08", 220.0), ("2025-09", 230.0)]
    assert analysis.backtest(p).first()["error"] == 0.0 and analysis.change(p).first()["change"] == 0.3333
    assert analysis.anomalies(p).count() == 0


def test_uneven_periods_per_record(spark):
    rows = [(f"m{m}", 100.0 if m < 4 else 120.0) for m in range(1, 7) for _ in range(4 if m < 4 else 2)]
    c = analysis.change(analysis.trend(spark.createDataFrame(rows, "label string, loss double"), "loss", F.col("label"))).first()
    assert (c["change"], c["change_per_record"], c["uneven"]) == (-0.4, 0.2, True)


def test_contributions_reconcile(linear):
    rows = analysis.contributions(linear, "sales", "team", F.col("month")).collect()
    assert {r["group"]: r["change"] for r in rows} == {"Alpha": 50.0, "Beta": 0.0}
    assert sum(r["change"] for r in rows) == rows[0]["total_change"]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert df.agg(analysis.pearson(F.col("a"), F.col("b"))).first()[0] is None


def test_options_and_sensitivity(linear):
    g = analysis.groups(linear, "sales", "team", ROW)
    o = analysis.options(g, analysis.contributions(linear, "sales", "team", F.col("month")))
    assert {r["key"]: r["expected_gain"] for r in o.collect()} == {"protect_leader": 75.0, "grow_laggard": 30.0, "hold_course": 0.0}
    assert {r["winner"] for r in analysis.sensitivity(o).collect()} == {"protect_leader"}
    assert analysis.break_even(o).first()[0] == 2.5


def test_governance(spark):
    g = governance.load_glossary([{"key": "r", "columns": ["revenue"], "certified": True, "owner": "x", "formula": {"op": "multiply", "inputs": ["p", "u"]}}, {"key": "r", "columns": []}, {"key": "c", "columns": ["a"], "certified": True}])
    assert [m.key for m in g.metrics] == ["r"] and len(g.problems) == 3
    df = spark.createDataFrame([(10.0, 2.0, 20.0), (10.0, 3.0, 33.0), (None, 1.0, 1.0)], "p double, u double, revenue double")
    r = governance.conformance(df, "revenue", g.metrics[0].formula).first()
    assert (r["checked"], r["matching"], r["skipped"], r["rate"]) == (2, 1, 1, 0.5)
    assert governance.resolve_measure([], ["x", "Amount"], ["x", "Amount"])[0] == "Amount"
    assert governance.conformance(df.drop("u"), "revenue", g.metrics[0].formula) is None


def test_experiment(spark):
    rng = random.Random(5)
    rows = [("control", rng.gauss(10, 1)) for _ in range(500)] + [("b", rng.gauss(11, 1)) for _ in range(500)] + [("c", rng.gauss(10, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "variant string, score double")
    assert experiments.find_column(df, ["variant"]) == ("variant", ["b", "c", "control"])
    got = {r["arm"]: r for r in experiments.compare(experiments.arm_stats(df, F.col("variant"), F.col("score"))).collect()}
    assert got["b"]["beyond_chance"] and not got["c"]["beyond_chance"]
    assert got["b"]["low"] < got["b"]["fixed_low"] and got["b"]["baseline"] == "control"
    assert not experiments.lopsided(experiments.arm_stats(df, F.col("variant"), F.col("score"))).first()["lopsided"]


def test_always_valid_range_holds_under_peeking():
    rng = np.random.default_rng(11)
    alpha, rho2 = 0.05, experiments.tuning(0.05) ** 2
    false = fixed = 0
    for _ in range(300):
        x = rng.normal(size=600)
        n = np.arange(2, 601)
        mean, se = np.cumsum(x)[1:] / n, 1 / np.sqrt(n)
        s = n * rho2
        width = se * np.sqrt(2 * (s + 1) / s * np.log(np.sqrt(s + 1) / alpha))
        false += bool((np.abs(mean) > width).any())
        fixed += bool((np.abs(mean) > 1.96 * se).any())
    assert false / 300 <= 0.05 and fixed / 300 > 0.2


# ---- models


def test_regression_beats_and_noise_is_weak(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        price, ads, web = rng.uniform(1, 10), rng.uniform(0, 5), rng.choice(["web", "shop"])
        rows.append((price, ads, web, 50 + 8 * price - 3 * ads + 6 * (web == "web") + rng.gauss(0, 1), i))
    df = spark.createDataFrame(rows, f"price double, ads double, channel string, sales double, {ROW} long")
    card = models.regression(df, ["price", "ads"], ["channel"], "sales")
    assert card["verdict"] == "useful" and card["explained"] > 0.9
    noise = spark.createDataFrame([(rng.random(), rng.random(), rng.random(), i) for i in range(400)], f"a double, b double, sales double, {ROW} long")
    assert models.regression(noise, ["a", "b"], [], "sales")["verdict"] == "weak"
    assert not models.regression(noise.limit(10), ["a"], [], "sales")["fitted"]


def test_classes_and_clusters(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0 if i % 2 else 6, 1), rng.gauss(0 if i % 2 else 6, 1), "u" if i % 2 else "v", i) for i in range(200)]
    df = spark.createDataFrame(rows, f"x double, y double, kind string, {ROW} long")
    card = models.classification(df, ["x", "y"], [], "kind")
    assert card["score"] > 0.95 and card["verdict"] == "useful"
    found = models.clusters(df, ["x", "y"])
    assert found["k"] == 2 and found["verdict"] == "found"


def test_seasonal(spark):
    pattern = [0, 5, 10, 3, -4, -9, 2, 7, 1, -6, -5, -4]
    rows = [(f"{2021 + i // 12}-{i % 12 + 1:02d}", 100.0 + i + pattern[i % 12]) for i in range(48)]
    card = models.seasonal(spark.createDataFrame(rows, "label string, total double"), "month")
    assert card["verdict"] == "useful" and card["error"] < 0.5
    assert not models.seasonal(spark.createDataFrame(rows[:24], "label string, total double"), "month")["fitted"]


# ---- detectors and maintenance


def test_identity_collapse(spark):
    bad = [(f"A{k}", ["Pump", "Fan"][r % 2], ["X", "Y"][r // 2], str(r + k)) for k in range(12) for r in range(4)]
    good = [(f"A{k}", ["Pump", "Fan"][k % 2], ["X", "Y"][k % 2], str(r + k)) for k in range(12) for r in range(4)]
    columns = ["Asset_ID", "Asset_Class", "Site", "Reading"]
    assert [f.columns[0] for f in detectors.identity_collapse(detectors.Shape.of(frame(spark, columns, bad)))] == ["Asset_ID"]
    assert detectors.identity_collapse(detectors.Shape.of(frame(spark, columns, good))) == []


def test_leakage_and_placeholder(spark):
    rows = [("Run" if i % 2 else "Stop", "0" if i % 2 else "5", "0" if i % 2 else "9", str(i), "0" if i % 2 else str((i % 10) / 10)) for i in range(200)]
    found = detectors.run_all(frame(spark, ["Type", "Downtime", "Failures", "Cost", "Rate"], rows), ROW)
    kinds = {f.detector: f for f in found}
    assert kinds["target_leakage"].numbers["explained_by"] == "Type"
    assert kinds["placeholder_rates"].columns == ["Rate", "Type"]
    assert found[0].severity == "high"
    thin = [("a" if i < 2 else "b", "1" if i < 2 else "0") for i in range(200)]
    assert detectors.target_leakage(detectors.Shape.of(frame(spark, ["Team", "Incidents"], thin)), ROW) == []


def test_scale_identity_periods(spark):
    rows = [("0.5", str(100 + i), str(50 + i), "30", f"{2020 + (i > 30)}-01-01") for i in range(40)]
    found = {f.detector for f in detectors.run_all(frame(spark, ["load_pct", "repair_cost", "parts_cost", "labour_cost", "record_date"], rows), ROW)}
    assert {"scale_mislabelled", "broken_identity", "uneven_periods"} <= found


def test_kpis(spark):
    columns = ["Work_Order_Type", "First_Time_Fix_Count", "Corrective_WO_Count", "Operating_Hours", "Planned_Operating_Hours"]
    rows = [("Corrective", "2", "2", "80", "100"), ("Corrective", "1", "2", "", "100"), ("Preventive", "9", "9", "0", "0"), ("Corrective", "", "1", "nan", "10")]
    able, missing = maintenance.computable(columns, maintenance.register())
    got = {r["kpi"]: r for r in maintenance.compute(frame(spark, columns, rows), able).collect()}
    fix = got["first_time_fix"]
    assert (fix["value"], fix["records"], fix["excluded"], fix["unmeasured"]) == (75.0, 2, 1, 1)
    assert got["operating_share"]["value"] == 80.0 and "Downtime_Hours" in missing["downtime_per_record"]


def test_contract_and_risk(spark):
    assert maintenance.tier(["record id", "Record_Date", "Asset_ID", "Downtime_Hours", "Failure_Count", "Maintenance_Cost_USD"]) == "maintenance"
    usable, why = maintenance.model_inputs(["Record_ID", "Site", "Downtime_Hours", "Color"])
    assert usable == ["Site"] and set(why) == {"Record_ID", "Downtime_Hours", "Color"}
    rng = random.Random(2)
    rows = []
    for i in range(600):
        age = rng.uniform(0, 10)
        rows.append((f"R{i}", f"2024-{1 + i // 50:02d}-01", "Corrective", str(round(age, 2)), rng.choice("AB"), str(10), str(10 + (5 if age + rng.gauss(0, 1) > 5 else -5))))
    df = frame(spark, ["Record_ID", "Record_Date", "Work_Order_Type", "Asset_Age_Years", "Site", "SLA_Target_Hours", "SLA_Actual_Hours"], rows)
    card = maintenance.risk(df, "sla_breach")
    assert card["verdict"] == "useful" and card["claim"] == "finding" and card["score"] > 0.8


def test_silhouette_brute(spark):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(0, 1, (15, 3)), r.normal(4, 1, (10, 3)), r.normal((0, 8, 0), 2, (8, 3)), [[9.0, 9.0, 9.0]]])
    group = [0] * 15 + [1] * 10 + [2] * 8 + [3]
    df = spark.createDataFrame([(int(g), [float(x) for x in p]) for g, p in zip(group, points, strict=True)], "group int, vector array<double>")
    scores = []
    for i, g in enumerate(group):
        far = {h: np.sqrt(np.mean([((points[i] - points[j]) ** 2).sum() for j in range(len(group)) if group[j] == h and j != i])) for h in set(group) if h != g or group.count(g) > 1}
        a, b = far.get(g), min(v for h, v in far.items() if h != g)
        scores.append(0.0 if a is None else (b - a) / max(a, b))
    assert models.silhouette(df).first()[0] == pytest.approx(np.mean(scores))


def test_merged_figures_follow_inner_joins(spark):
    """An inner join in the middle drops rows for the joins after it, in their figures and in the table."""
    rows = spark.createDataFrame([(f"k{i % 4}", f"m{i % 3}", float(i), i) for i in range(24)], f"k string, m string, v double, {ROW} long")
    one = joins.Lookup(spark.createDataFrame([("k0", "x"), ("k1", "y"), ("k9", "z")], "code string, city string"), frozenset())
    two = joins.Lookup(spark.createDataFrame([("m0", 1.0), ("m1", 2.0)], "code string, rate double"), frozenset({"rate"}))
    m = joins.merge(AnalysisTable(rows, frozenset({"v"})), [one, two], [joins.Join((("k", "code"),), "inner", name="one"), joins.Join((("m", "code"),), name="two")])
    assert [(s["rows_in"], s["matched"], s["rows_out"], s["lookup_unused"], s["empty_keys"]) for s in m.stats] == [(24, 12, 12, 1, 0), (12, 8, 12, 0, 0)]
    assert m.table.columns == ["k", "m", "v", "city", "rate"] and m.table.df.count() == 12


def test_shares_of_many_groups_match_a_plain_running_sum(spark):
    """Ranges of groups are summed apart and joined: ties, places and the cumulative share are those of one sorted list."""
    totals = [(f"g{i}", float((i * 37) % 101), i) for i in range(400)]
    df = spark.createDataFrame(totals, "group string, total double, first_seen long")
    whole = sum(t for _, t, _ in totals)
    want, upto = [], 0
    for place, (g, t, _) in enumerate(sorted(totals, key=lambda r: (-r[1], r[2])), 1):
        share = round(t / whole, 4)
        upto += round(share * 10_000)
        want.append((g, t, share, upto / 10_000, place))
    got = analysis.shares(df.repartition(7)).orderBy("place").collect()
    assert [tuple(r) for r in got] == want
    c = analysis.concentration(analysis.shares(df)).first()
    assert c["segments"] == 400 and c["pareto_count"] == sum(r[3] < 0.8 for r in want) + 1
    assert analysis.shares(df.where("total = 0")).count() == 0
    assert analysis.shares(df.limit(0)).count() == 0


def test_more_labels_than_periods(spark):
    labels = spark.range(30).select(F.col("id").cast("string").alias("label"))
    assert analysis.few_periods(labels, 30) and not analysis.few_periods(labels, 29)
