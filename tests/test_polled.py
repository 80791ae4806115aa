"""A polled file as a stream: versions, repeats, failures, and a resumed query."""

from plumbline.sources import polled
from plumbline.streaming import live


def once(spark, url, tmp_path, name="out"):
    """One run over what is there, resumed from the checkpoint of the run before."""
    stream = polled.polled(spark, url, str(tmp_path / "keep"), "tests.local_fetch:fetch")
    stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(once=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())


def test_versions_of_a_polled_file(spark, tmp_path):
    body = tmp_path / "remote.csv"
    body.write_text("a,b\n1,2\n")
    url = f"https://files.example{body}"
    first = [(1, 0, "a,b"), (1, 1, "1,2")]
    assert once(spark, url, tmp_path) == first
    assert once(spark, url, tmp_path) == first  # unchanged
    body.unlink()
    assert once(spark, url, tmp_path) == first  # gone for a while
    body.write_bytes("﻿a,b\r\n3,é\r\n".encode())
    assert once(spark, url, tmp_path) == [*first, (2, 0, "a,b"), (2, 1, "3,é")]
    body.write_text("a,b\n1,2\n")
    assert once(spark, url, tmp_path)[-1] == (3, 1, "1,2")  # back to an old body is a version too


def test_polled_versions_become_snapshots(spark, tmp_path):
    body = tmp_path / "remote.txt"
    body.write_text("x\ny\n")
    seen = []
    snapshots = live.SnapshotStream(str(tmp_path / "snap"), lambda df: seen.append(sorted(r["line"] for r in df.collect())))
    for text in ("x\ny\n", "x\nz\n"):
        body.write_text(text)
        stream = polled.polled(spark, f"https://files.example{body}", str(tmp_path / "keep"), "tests.local_fetch:fetch").select("line")
        snapshots.start(stream, str(tmp_path / "progress"), once=True).awaitTermination()
    assert [x for x in seen if x] == [["x", "y"], ["x", "z"]]
