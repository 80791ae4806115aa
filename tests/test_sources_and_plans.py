import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, joins
from plumbline.operators.table import ROW
from plumbline.plans import extensions, stages
from plumbline.sources import files, store
from plumbline.streaming import live

TABLE = [["name", "n"], ["Ann", "1"], ["Bob", "2.5"]]


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(p)


def rows_of(got):
    return [got.columns, *[[r[c] for c in got.columns] for r in got.df.orderBy(ROW).collect()]]


def workbook(rows, *, visible=True, doctype=False, dates=False, mac=False):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        state = "" if visible else ' state="hidden"'
        z.writestr("xl/workbook.xml", ("<!DOCTYPE x>" if doctype else "") + f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{"<workbookPr date1904=" + chr(34) + "1" + chr(34) + "/>" if mac else ""}<sheets><sheet name="Hidden" sheetId="1" state="hidden" r:id="r1"/><sheet name="Data" sheetId="2"{state} r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        body = "".join(f"<row>{''.join(c for c in r)}</row>" for r in rows)
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def text_cell(x):
    return f'<c t="inlineStr"><is><t>{x}</t></is></c>'


def test_one_table_in_every_format(spark, tmp_path):
    xlsx = workbook([[text_cell("name"), text_cell("n")], [text_cell("Ann"), "<c><v>1</v></c>"], [text_cell("Bob"), "<c><v>2.5</v></c>"]])
    bodies = {
        "a.csv": "name,n\nAnn,1\nBob,2.5\n",
        "b.csv": "name;n\nAnn;1\nBob;2.5\n",
        "c.tsv": "name\tn\nAnn\t1\nBob\t2.5\n",
        "d.json": json.dumps([{"name": "Ann", "n": 1}, {"name": "Bob", "n": 2.5}]),
        "e.json": json.dumps({"columns": ["name", "n"], "data": [["Ann", 1], ["Bob", 2.5]]}),
        "f.json": json.dumps({"meta": 1, "records": [{"name": "Ann", "n": 1}, {"name": "Bob", "n": 2.5}]}),
        "g.jsonl": '{"name": "Ann", "n": 1}\n{"name": "Bob", "n": 2.5}\n',
        "h.json": json.dumps([["name", "n"], ["Ann", "1"], ["Bob", "2.5"]]),
        "i.xlsx": xlsx,
    }
    for name, body in bodies.items():
        got = rows_of(files.read_table(spark, put(tmp_path, name, body)))
        assert sorted(map(str, zip(*got))) == sorted(map(str, zip(*TABLE))), name


def test_ragged_and_quoted_csv(spark, tmp_path):
    got = files.read_table(spark, put(tmp_path, "r.csv", '﻿a,,a\n\n"x, y",2\n1,2,3,4\n'))
    assert got.columns == ["a", "column_2", "a_2", "column_4"] and got.warnings
    assert rows_of(got)[1:] == [["x, y", "2", "", ""], ["1", "2", "3", "4"]]


def test_nested_json(spark, tmp_path):
    got = files.read_table(spark, put(tmp_path, "n.jsonl", '{"z": {"a": 1, "b": [1, 2]}, "c": null}\n{"z": {"a": 2}, "d": true}\n'))
    assert got.columns == ["z.a", "z.b", "c", "d"]
    first = got.df.orderBy(ROW).first()
    assert first["z.a"] == "1" and json.loads(first["z.b"]) == ["1", "2"] and first["c"] == ""


def test_excel_cells(spark, tmp_path):
    rows, warned = files.sheet_rows(workbook([[text_cell("d"), text_cell("b")], ['<c s="1"><v>45000</v></c>', '<c t="b"><v>1</v></c>'], ['<c s="1"><v>60</v></c>', '<c t="e"><v>#REF!</v></c>'], ["<c><f>1+1</f></c>"]]))
    assert rows[1:3] == [["2023-03-15", "TRUE"], ["1900-02-29"]] and len(warned) == 2
    assert files.serial_to_text(0, mac=True) == "1904-01-01" and files.serial_to_text(1.5) == "1900-01-01 12:00:00"
    for bad in (workbook([], doctype=True), workbook([], visible=False), workbook([['<c r="ZZZ1"><v>1</v></c>']]), b"PK\x03\x04nope"):
        with pytest.raises(files.SourceError):
            files.sheet_rows(bad)


def test_detection():
    assert files.detect_format("x", b'{"a": 1}\n{"a": 2}') == "jsonl" and files.detect_format("x", b"[1]") == "json"
    assert files.sniff_delimiter("a|b|c\n1|2|3\n") == "|" and files.sniff_delimiter("one\ntwo\n") == ","
    with pytest.raises(files.SourceError):
        files.detect_format("old.xls", b"")
    with pytest.raises(files.SourceError):
        files.encoding_of("naïve".encode("latin-1") + b" text")


def test_snapshot_is_content_addressed(spark, tmp_path):
    a = store.sample_dataset(spark)
    assert a.count() == 72
    path, written = store.snapshot(a, str(tmp_path / "s"))
    again, rewritten = store.snapshot(a.repartition(3), str(tmp_path / "s"))
    assert written and not rewritten and path == again
    other, new = store.snapshot(a.withColumn("units", F.lit("1")), str(tmp_path / "s"))
    assert new and other != path


def test_addresses():
    public = lambda *_: [(0, 0, 0, "", ("93.184.216.34", 443))]
    private = lambda *_: [(0, 0, 0, "", ("10.0.0.1", 443))]
    assert store.check_address("https://example.com/a.csv", public).ip == "93.184.216.34"
    for url, how in (("http://example.com", public), ("https://u:p@example.com", public), ("https://example.com/?api_key=1", public), ("https://example.com", private)):
        with pytest.raises(store.AddressError):
            store.check_address(url, how)
    hour = dt.timedelta(hours=1)
    now = dt.datetime(2025, 1, 1)
    assert store.next_check(now, hour, 2) == now + 4 * hour and store.next_check(now, hour, 9) == now + dt.timedelta(days=1)


def test_whole_run(spark):
    ctx = stages.run(stages.Context(store.sample_dataset(spark), goal="Sales"))
    assert ctx.results["validator"].output["passed"], ctx.results["validator"].checks
    assert ctx.measure == "revenue" and ctx.breakdown == "region"
    assert ctx.results["preparer"].output["total"] == ctx.table.df.agg(F.sum("revenue")).first()[0]
    assert len(ctx.results["predictive"].output["forecast"]) == 3
    assert "# Sales" in stages.report(ctx)
    claims, calcs = stages.evidence_frame(spark, ctx.results)
    assert stages.dangling(claims, calcs).count() == 0


def test_run_with_lookups(spark):
    offices = spark.createDataFrame([("North", "Ann Lee", "a@mail.example", 0), ("West", "Bob Ray", "b@mail.example", 1)], f"place string, lead string, contact string, {ROW} long")
    join = joins.Join((("region", "place"),), name="offices.csv")
    ctx = stages.run(stages.Context(store.sample_dataset(spark), lookups=[(offices, join, None)], join_breakdown="lead"))
    assert ctx.results["validator"].output["passed"], ctx.results["validator"].checks
    assert ctx.breakdown == "lead" and {"cl_join_0", "cl_join_private"} <= {c.id for c in ctx.results["merge"].claims}
    assert [(c.name, c.value) for c in ctx.results["merge"].calculations][:4] == [("rows_before_offices", 72), ("rows_matched_offices", 36), ("rows_after_offices", 72), ("coverage_offices", 0.5)]
    ctx.results["merge"].output["joins"][0]["rows_out"] = 71
    assert [c.name for c in stages.validate(ctx).checks if not c.passed] == ["joins_keep_rows"]

    half = stages.run(stages.Context(store.sample_dataset(spark), lookups=[(offices, joins.Join(join.keys, "inner", name="offices.csv"), None)]))
    assert half.results["merge"].output["rows_after"] == 36 and "cl_join_0_left_out" in {c.id for c in half.results["merge"].claims}
    twice = stages.run(stages.Context(store.sample_dataset(spark), lookups=[(offices.unionByName(offices.selectExpr("place", "'C' AS lead", "contact", f"{ROW} + 2 AS {ROW}")), join, None)]))
    assert twice.results["merge"].status == "failed" and "repeats its key" in twice.results["merge"].summary


def test_the_audit_wants_what_is_not_certain_said(spark):
    ctx = stages.run(stages.Context(store.sample_dataset(spark)))
    for stage, claim, check in (("governance", "cl_measure_uncertified", "measure_certified_or_declared"), ("descriptive", None, "every_type_reported")):
        kept = ctx.results[stage].claims, ctx.results[stage].output
        ctx.results[stage].claims = [c for c in kept[0] if claim and c.id != claim]
        ctx.results[stage].output = kept[1] if claim else {}
        assert check in [c.name for c in stages.validate(ctx).checks if not c.passed]
        ctx.results[stage].claims, ctx.results[stage].output = kept
    ctx.results["predictive"].output["backtest_error"] = None
    assert [c.name for c in stages.validate(ctx).checks if not c.passed] == ["forecast_measured_or_declared"]


class Attainment:
    role = "attainment"

    def run(self, results, table):
        r = stages.Result()
        r.calc("attainment.total", "total", results["preparer"].output["total"], "from the preparer")
        r.claim("attainment.claim", "calculation", "The total is attained.", "attainment.total")
        return r


class Rude(Attainment):
    role = "rude"


def test_custom_stages(spark):
    found, bad = stages.load_custom([f"{__name__}:Attainment", "nowhere:X"])
    assert len(bad) == 1
    ctx = stages.run(stages.Context(store.sample_dataset(spark)), [*found, Rude()])
    assert ctx.results["attainment"].status == "succeeded" and ctx.results["rude"].status == "failed"
    assert ctx.results["validator"].output["passed"]


def test_profiles_and_example(spark):
    assert [s.role for s in extensions.stages_for()] == [] and [s.role for s in extensions.stages_for("maintenance")] == ["maintenance_governance", "maintenance_risk"]
    assert len(extensions.stages_for("none", {"none": ()})) == 0 and len(extensions.stages_for(profiles={})) == 6
    for profile, profiles in (("other", None), ("x", {"x": ("nothing",)})):
        with pytest.raises(ValueError, match="profile"):
            extensions.stages_for(profile, profiles)
    custom = [*extensions.stages_for("models"), *extensions.stages_for("maintenance"), extensions.TargetAttainment(1e6), extensions.RegressionModel()]
    with pytest.raises(ValueError, match="twice"):
        stages.run(stages.Context(store.sample_dataset(spark)), custom)
    ctx = stages.run(stages.Context(store.sample_dataset(spark), goal="Sales"), custom[:-1])
    assert all(ctx.results[s.role].status == "succeeded" for s in custom), {s.role: ctx.results[s.role].summary for s in custom}
    assert ctx.results["validator"].output["passed"], ctx.results["validator"].checks
    t = ctx.results["target_attainment"].output
    assert t["gap"] == round(1e6 - ctx.results["preparer"].output["total"], 2) and t["met"] == (t["gap"] <= 0)
    assert list(ctx.results).index("maintenance_governance") < list(ctx.results).index("preparer") < list(ctx.results).index("target_attainment") < list(ctx.results).index("lineage")

    signed = stages.approve(ctx, "owner")
    assert "## Figures" in stages.publish(ctx, signed)
    ctx.results["profiler"].claim("late", "fact", "Added after the approval.", "c_rows")
    for approval in (None, signed):
        with pytest.raises(ValueError, match="approved"):
            stages.publish(ctx, approval)


def test_nothing_runs_after_the_audit(spark):
    for after, why in (("validator", "audits"), ("nowhere", "no stage")):
        late = extensions.TargetAttainment(5)
        late.after = after
        with pytest.raises(ValueError, match=why):
            stages.run(stages.Context(store.sample_dataset(spark)), [late])


def test_several_files_are_in_order(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for k in range(4):
        (folder / f"part-{k}.csv").write_text(("n,t\n" if k == 0 else "") + "".join(f'{100 * k + i},"a ""b"", c"\n' for i in range(60)))
    got = files.read_table(spark, str(folder), "csv")
    rows = got.df.orderBy(ROW).collect()
    assert [r["n"] for r in rows] == [str(100 * k + i) for k in range(4) for i in range(60)] and [r[ROW] for r in rows] == list(range(240))
    assert {r["t"] for r in rows} == {'a "b", c'}
    broken = put(tmp_path, "q.csv", 'n,t\n1,"two\nlines"\n2,x\n')
    assert rows_of(files.read_table(spark, broken))[1:] == [["1", "two\nlines"], ["2", "x"]]


def test_half_written_snapshot_is_written_again(spark, tmp_path):
    a = store.sample_dataset(spark)
    path, _ = store.snapshot(a, str(tmp_path / "s"))
    (tmp_path / "s" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert store.snapshot(a, str(tmp_path / "s")) == (path, True)


def test_cursor_of_now(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:01", "run", 1), ("2025-01-01 00:00:02", "run", 2)], "t string, kind string, id int").withColumn("t", F.to_timestamp("t"))
    now = live.cursor_now(df, "t")
    assert live.poll(df, now, "t", "kind", "id").count() == 0
    later = df.unionByName(df.limit(1).withColumn("t", F.lit("2025-01-01 00:00:03").cast("timestamp")))
    assert live.poll(later, now, "t", "kind", "id").count() == 1


def test_no_numbers_fails(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], f"x string, {ROW} long")
    ctx = stages.run(stages.Context(df))
    assert ctx.results["cleaner"].status == "failed" and "governance" not in ctx.results


def test_snapshot_stream(spark, tmp_path):
    src = tmp_path / "in"
    seen = []
    stream = live.SnapshotStream(str(tmp_path / "snap"), lambda df: seen.append(df.count()))
    spark.range(5).write.parquet(str(src))
    for _ in range(2):
        live_df = live.table_stream(spark, str(src), "id long")
        stream.start(live_df, str(tmp_path / "ck")).awaitTermination()
        spark.range(5).write.mode("append").parquet(str(src))
    assert seen == [5] and [x.changed for x in stream.log] == [True, False]


def test_updates_once(spark, tmp_path):
    src = str(tmp_path / "u")
    rows = [("2025-01-01 00:00:01", "run", 1), ("2025-01-01 00:00:01", "run", 1), ("2025-01-01 00:00:02", "run", 2)]
    spark.createDataFrame(rows, "t string, kind string, id int").withColumn("t", F.to_timestamp("t")).write.parquet(src)
    q = live.updates(live.table_stream(spark, src, "t timestamp, kind string, id int"), "t", "kind", "id").writeStream.format("memory").queryName("u").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("u").count() == 2
    df = spark.read.parquet(src)
    assert [r["id"] for r in live.poll(df, "2025-01-01 00:00:01~run~1", "t", "kind", "id").collect()] == [2]
    assert live.poll(df, "nonsense", "t", "kind", "id").count() == 0


def test_carry_mapping(spark):
    df = store.sample_dataset(spark)
    m = clean.Mapping({"month": "date", "region": "dimension", "category": "dimension", "revenue": "measure", "units": "measure"}, "revenue", "region")
    assert live.carry_mapping(df, m) is not None and live.carry_mapping(df.drop("units"), m) is None
