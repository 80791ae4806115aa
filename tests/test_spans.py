"""Quoted CSV and JSON lists cut at every place give the rows of an uncut file."""

import csv
import io
import json
import random

import pytest

from plumbline.sources import files, spans

CELLS = ["", "a", "b c", 'say "hi"', "two\nlines", "x,y", '"', '""', "\n", ",\n,", 'end"\n"start', "é\n؟", "\r\ncr", "long " * 9]


def cut_small(spark, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture(autouse=True)
def as_before(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def quoted(tmp_path_factory):
    rnd = random.Random(4)
    rows = [["k", "two\nlined", "z"]] + [[str(i), rnd.choice(CELLS), rnd.choice(CELLS)] for i in range(40)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    body = out.getvalue().replace('\r\n7,', '\r\n\r\n7,').encode("utf-8-sig")
    path = tmp_path_factory.mktemp("csv") / "quoted.csv"
    path.write_bytes(body)
    return path, rows, body


@pytest.mark.parametrize("n", [1 << 20, 3, 7, 16, 29, 64])
def test_csv_cut_anywhere(spark, quoted, n):
    path, rows, body = quoted
    cut_small(spark, n)
    got = [r["value"] for r in spans.csv_records(spark, str(path), ",").orderBy("_row_id").collect()]
    assert [next(csv.reader(io.StringIO(x, newline=""))) for x in got] == rows
    if n in (7, 64):
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 3  # many tasks
        done = files.read_table(spark, str(path))
        assert done.columns == rows[0]
        assert [list(r)[:-1] for r in done.df.orderBy("_row_id").collect()] == rows[1:]
        assert [r["_row_id"] for r in done.df.orderBy("_row_id").collect()] == list(range(40))


def test_quotes_inside_plain_cells(spark, tmp_path):
    """A quote that does not begin a cell is text; after a closing quote the rest of the cell is text too."""
    (tmp_path / "a.csv").write_text('size,name\n5" disk,plain\n3,"a ""b""\nc"\n7" x,"d\n",\n8,e"\n9,f\n')
    got = [r["value"] for r in spans.csv_records(spark, str(tmp_path / "a.csv"), ",").orderBy("_row_id").collect()]
    assert got == ["size,name", '5" disk,plain', '3,"a ""b""\nc"', '7" x,"d\n",', '8,e"', "9,f"]


def test_several_files_and_an_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('3,"never\nclosed\n')
    got = [r["value"] for r in spans.csv_records(spark, str(tmp_path), ",").orderBy("_row_id").collect()]
    assert got[:2] == ["a,b", '1,"x\ny"'] and "".join(got[2:]).startswith('3,"never\nclosed')


@pytest.fixture(scope="module")
def listed(tmp_path_factory):
    rnd = random.Random(6)
    texts = ["", "a", "}", "{", '"', "\\", '\\"', "],[", "é}", "\n", "a,b", '{"x":1}', "ends\\\\"]
    rows = [{"k": i, "t": rnd.choice(texts), **({"n": {"a": rnd.choice(texts), "l": [{"z": rnd.choice(texts)}] * rnd.randrange(3)}} if rnd.random() < 0.6 else {})} for i in range(40)]
    path = tmp_path_factory.mktemp("json") / "list.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=rnd.choice([1, None])))
    return path, rows


@pytest.mark.parametrize("n", [1 << 20, 3, 7, 16, 29, 64])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_cut_anywhere(spark, listed, tmp_path, n, indent):
    _, rows = listed
    path = tmp_path / "list.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=indent) + "\n" * (n % 2))
    cut_small(spark, n)
    got = [json.loads(r["value"]) for r in spans.json_elements(spark, str(path)).orderBy("_row_id").collect()]
    assert got == rows
    if n in (7, 64):
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
        done = files.read_table(spark, str(path))
        found = done.df.orderBy("_row_id").collect()
        assert [(r["k"], r["t"], r["n.a"]) for r in found] == [(str(x["k"]), x["t"], x.get("n", {}).get("a", "")) for x in rows]
        assert done.columns[:2] == ["k", "t"]


def test_lists_that_hold_more_than_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, null, {"a": 2}]')
    assert [r["a"] for r in files.read_table(spark, str(tmp_path / "a.json")).df.where("a <> ''").orderBy("_row_id").collect()] == ["1", "2"]
    (tmp_path / "b.json").write_text('[{"a": 1}')
    (tmp_path / "c.json").write_text('[\n {"a": {"b": "x}"}}\n]\n')
    done = files.read_table(spark, str(tmp_path / "c.json"))
    assert done.columns == ["a.b"] and done.df.first()["a.b"] == "x}"
