"""A remote file, looked at again and again, as a stream of its versions.

A file behind an https address becomes a streaming source: a version is a body that differs from the one before, and its
lines are the stream's rows. An offset is a version's number with the hash of its body, so a query that resumes from its
checkpoint knows what it has taken; bodies that were taken are kept by their hash until they are committed, and a batch that
is run again gets the same lines. The address rules, the size and the time of ``store.fetch`` hold for every look.

Spark reads such a source on its driver; a body is at most ``store.fetch``'s few megabytes. Defined cases: an unchanged
body, and one that can't be had, gives no rows (the latter is told by a warning and looked for again next time); an empty
body is a version without rows; line ends of any kind end lines; text that is no UTF-8 is read with marks of replacement.
"""

from __future__ import annotations

import hashlib
import importlib
import os
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "version long, place long, line string"


class PolledFile(DataSource):
    """Options: ``url``; ``keep``, a folder for bodies taken but not committed; ``fetch``, as ``module:function``, what gets a
    body (``store.fetch``)."""

    @classmethod
    def name(cls) -> str:
        return "polled_file"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.keep = options["url"], Path(options["keep"])
        self.fetch = _named(options.get("fetch", "plumbline.sources.store:fetch"))

    def initialOffset(self) -> dict:
        return {"version": 0, "hash": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            body = self.fetch(self.url)
        except (OSError, ValueError) as e:
            warnings.warn(f"The address could not be read: {e}", stacklevel=2)
            return iter(()), start
        found = hashlib.sha256(body).hexdigest()
        if found == start["hash"]:
            return iter(()), start
        self.keep.mkdir(parents=True, exist_ok=True)
        half = self.keep / f"{found}.{os.getpid()}"
        half.write_bytes(body)
        half.replace(self.keep / found)  # a body is there whole or not at all
        end = {"version": start["version"] + 1, "hash": found}
        return _rows(end["version"], body), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start["hash"] == end["hash"]:
            return iter(())
        return _rows(end["version"], (self.keep / end["hash"]).read_bytes())

    def commit(self, end: dict) -> None:
        for kept in self.keep.glob("*"):
            if kept.name != end["hash"]:
                kept.unlink(missing_ok=True)


def _named(place: str) -> Callable[[str], bytes]:
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def _rows(version: int, body: bytes) -> Iterator[tuple]:
    """A list's iterator, which Spark copies."""
    return iter([(version, place, line) for place, line in enumerate(body.decode("utf-8-sig", errors="replace").splitlines())])


def polled(spark: SparkSession, url: str, keep: str, fetch: str | None = None) -> DataFrame:
    """The stream of a remote file's versions: version, place and line."""
    spark.dataSource.register(PolledFile)
    reader = spark.readStream.format("polled_file").option("url", url).option("keep", keep)
    return (reader.option("fetch", fetch) if fetch else reader).load()
