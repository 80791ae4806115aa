"""Costly steps stand once in a plan, and give what the plain forms give."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import numbers, text
from plumbline.operators import maintenance, models
from plumbline.operators.table import ROW


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_lowered_once_for_all_phrases(spark):
    df = spark.createDataFrame([(0, "A P-Value, ANOVA and z-test; the NULL hypothesis"), (1, None), (2, ""), (3, "plain")], "i int, t string")
    made = df.select("i", text.jargon_phrases(F.col("t")).alias("p"))
    assert {r["i"]: r["p"] for r in made.collect()} == {0: [j for j in text.JARGON if j in "a p-value, anova and z-test; the null hypothesis"], 1: [], 2: [], 3: []}
    assert plan(df.select("i", text.jargon(F.col("t")).alias("p"))).count("lower(coalesce") == 1


def test_a_cell_is_parsed_once_where_it_is_filtered(spark):
    cells = ["1", " 1,234.5 ", "-.5e3", "1e999", "-1e999", "NaN", "Infinity", "1d", "0x1p3", "", " ", None, "12\n", "12\r\n", "12\n\n", "\n12", "1.2.3", "+7.", "1 2", "12\u0085", "12 "]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    trimmed = F.trim(F.regexp_replace("t", ",", ""))
    plain = numbers.finite(F.when(trimmed.rlike(numbers.PLAIN), trimmed.try_cast("double")))
    both = df.select("i", numbers.plain_number(F.col("t")).alias("got"), plain.alias("plain")).collect()
    assert [r["got"] for r in both] == [r["plain"] for r in both] and both[1]["got"] == 1234.5 and both[12]["got"] == 12.0
    assert plan(df.where(numbers.plain_number(F.col("t")).isNotNull())).count("t#") <= 4  # the filter's one, those of Spark's own null check and scan


def test_rule_counts_are_the_counted_guesses(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", None, "only test" if i % 5 == 0 else "c"]), rnd.random() < 0.5) for i in range(400)]
    df = models.split(spark.createDataFrame(rows, f"{ROW} long, g string, label boolean"))
    guessed = maintenance.rule_guess(df.where(~F.col("held_out")), df.where("held_out"), "g", ROW)
    counted = maintenance.rule_counts(df, "g", ROW)
    as_rows = lambda x: sorted(map(tuple, x.collect()))
    assert as_rows(guessed.groupBy("actual", "predicted").agg(F.count("*").alias("n"))) == as_rows(counted)
    assert as_rows(models.balanced_accuracy(guessed)) == as_rows(models.balanced_accuracy(counted))


def test_a_quantile_is_the_percentile(spark):
    rnd = random.Random(6)
    for values in ([], [None], [3.0], [1.0, 2.0], [rnd.choice([0.0, -1.5, 2.25, rnd.random(), None]) for _ in range(501)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for share in (0.0, 0.3, 0.75, 1.0):
            assert models.quantile(df, "v", share) == df.agg(F.expr(f"percentile(v, {share}D)")).first()[0]


def test_a_key_is_read_as_both_rules_read_it(spark):
    cells = ["1", " 12.50 ", "(5)", "( 1,200 )", "(0)", "1,2", "1,234", "SAR 7", "7 usd", "12%", "-3e2", "1e999", "(1e999)", "", None, "n/a", "NaN", "٣", "−4", "12\n", "(3)\n", "1 234", "1.0", "(-2)"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    trimmed = F.trim("t")
    t = F.translate(numbers.western(trimmed), "٫٬−" + numbers.HARD_SPACES, ".,-" + " " * len(numbers.HARD_SPACES))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^\(\s*(.*?)\s*\)$", "$1"), numbers.CURRENCY, ""))
    n = F.regexp_replace(F.regexp_extract(F.trim(F.regexp_replace(t, "%$", "")), f"{numbers.PLAIN}|{numbers.GROUPED}", 0), "[, ]", "").try_cast("double")
    mapped = numbers.finite(F.when(trimmed.rlike(r"^\(.*\)$"), -n).otherwise(n))
    c = F.col("t")
    for r in df.select("i", numbers.mapped_number(c).alias("m"), mapped.alias("m0"), numbers.key_number(c).alias("k"), F.coalesce(mapped, numbers.plain_number(c)).alias("k0")).collect():
        assert str(r["m"]) == str(r["m0"]) and str(r["k"]) == str(r["k0"]), cells[r["i"]]
    assert plan(df.where(numbers.mapped_number(c).isNotNull())).count("regexp_extract") == 1


def test_a_quoted_file_is_parsed_in_two_passes(spark, tmp_path):
    from plumbline.sources import files

    path = tmp_path / "t.csv"
    path.write_bytes('﻿\r\n  \r\nkey,note\r\n1,"a, ""b""\nc"\r\n,\r\n2,x,\r\n"3",,"z"\r\n4\r\n'.encode())
    table = files.read_table(spark, str(path))
    rows = [tuple(r) for r in table.df.orderBy(ROW).collect()]
    assert table.df.columns == ["key", "note", "column_3", ROW]
    assert [r[:3] for r in rows] == [("1", 'a, "b"\nc', ""), ("2", "x", ""), ("3", "", "z"), ("4", "", "")]
    assert plan(table.df).count("from_csv") <= 2  # the filter of blank rows and the cells


def test_clusters_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_TASK", 50)
    df = spark.range(400).coalesce(1).select(F.col("id").alias(ROW), (F.col("id") % 2 * 100 + F.col("id") % 7).cast("double").alias("x"))
    seen = []
    whole = models.silhouette
    monkeypatch.setattr(models, "silhouette", lambda points: (seen.append(points.rdd.getNumPartitions()), whole(points))[1])
    found = models.clusters(df, ["x"])
    assert found["k"] == 2 and found["verdict"] == "found" and min(seen) > 1


def test_the_best_rule_reads_rows_once_for_each_candidate(spark):
    rnd = random.Random(5)
    rows = [(i, g, "x", g == "a" and rnd.random() < 0.9) for i in range(300) for g in [rnd.choice("ab")]]
    df = models.split(spark.createDataFrame(rows, f"{ROW} long, g string, one string, label boolean").withColumn("label", F.col("label").cast("string")))
    guessed = maintenance.rule_guess(df.where(~F.col("held_out")), df.where("held_out"), "g", ROW)
    assert maintenance.best_rule(df, ["one", "g"], ROW) == ("g", models.balanced_accuracy(guessed).first()[0])


def risk_rows(spark, periods):
    rnd = random.Random(periods)
    rows = []
    for i in range(900):
        age, site = rnd.choice(["0", "1.5", "1,000", "3", "4", "", None, "n/a"]), rnd.choice(["A", "B", "", None])
        late = rnd.random() < (0.8 if age in ("3", "4") or site == "B" else 0.3)
        rows.append((i, rnd.choice([*[f"2024-{1 + rnd.randrange(periods):02d}"] * 4, "", None]), rnd.choice(["Corrective", "Preventive"]), site, age, "0.1", rnd.choice(["8", "8", ""]), "9" if late else "7.5"))
    return spark.createDataFrame(rows, f"{ROW} long, Record_Date string, Work_Order_Type string, Site string, Asset_Age_Years string, Planned_Operating_Hours string, SLA_Target_Hours string, SLA_Actual_Hours string")


def risk_of_rows(df):
    """What ``maintenance.risk`` says, from the rows themselves."""
    numeric, texts, order = ["Asset_Age_Years", "Planned_Operating_Hours"], ["Work_Order_Type", "Site"], ROW
    rows = models.split(maintenance.labelled(df, "sla_breach"), "Record_Date", order)
    rows = rows.select(order, *texts, *[numbers.as_number(rows, c).alias(c) for c in numeric], F.col("label").cast("string").alias("label"), "held_out")
    sizes = rows.where(~F.col("held_out")).count(), rows.where("held_out").count()
    inputs = models.Inputs.of(rows.where(~F.col("held_out")), numeric, texts, order)
    rows = rows.where(inputs.complete())
    train, test = rows.where(~F.col("held_out")), rows.where("held_out")
    x = models.scaled(train, inputs.columns)
    model = models.naive_bayes(train, x, F.col("label")).collect()
    score = models.balanced_accuracy(test.select(F.col("label").alias("actual"), models.classify(model, x).alias("predicted"))).first()[0]
    rules = {c: models.balanced_accuracy(maintenance.rule_guess(train, test, c, order)).first()[0] for c in texts}
    return sizes, score, max(0.5, *rules.values())


def test_a_risk_card_is_that_of_the_rows(spark):
    for periods in (3, 8):  # every fifth row is held out, or the latest periods
        df = risk_rows(spark, periods)
        card = maintenance.risk(df, "sla_breach")
        assert ((card["train"], card["test"]), card["score"], card["baseline"]) == risk_of_rows(df) and 0.55 < card["score"] < 0.95


def test_a_risk_card_reads_the_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(cell):
        read.add(1)
        return cell

    df = risk_rows(spark, 8).localCheckpoint()
    assert maintenance.risk(df.withColumn("SLA_Actual_Hours", F.udf(seen, "string")("SLA_Actual_Hours")), "sla_breach")["fitted"]
    assert read.value == 900


def test_counted_rows_give_the_models_of_the_rows(spark):
    rnd = random.Random(9)
    rows = [(i, 0.1, 1e6 + rnd.choice([0.25, 0.5, 2.0]), rnd.choice(["a", "b", "c", None]), rnd.choice("xy")) for i in range(700)]
    df = spark.createDataFrame(rows, "o long, same double, far double, t string, label string")
    one = df.groupBy("same", "far", "t", "label").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    plain, counted = models.Inputs.of(df, ["same", "far"], ["t"], "o"), models.Inputs.of(one, ["same", "far"], ["t"], "o", "n")
    assert plain.names == counted.names
    models_of = [sorted(models.naive_bayes(d, models.scaled(d, i.columns, n), F.col("label"), n).collect()) for d, i, n in ((df, plain, None), (one, counted, "n"))]
    for a, b in zip(*models_of, strict=True):
        assert a["label"] == b["label"] and a["prior"] == b["prior"] and b["means"][0] == 0 and b["spreads"][0] == models.LEAST_SPREAD
        assert all(abs(x - y) < 1e-9 for x, y in zip([*a["means"], *a["spreads"]], [*b["means"], *b["spreads"]], strict=True))


def test_a_risk_that_is_not_known_is_refused(spark):
    with pytest.raises(ValueError, match="no such target"):
        maintenance.risk(risk_rows(spark, 3), "color")
