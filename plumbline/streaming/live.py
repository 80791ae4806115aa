"""Data that changes: snapshots taken when a source's content changes, and a feed of updates without repeats.

Event-time windows and sessions are extensions; the rest mirrors a micro-batch poller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean
from ..operators.table import number_rows
from ..sources.store import snapshot

#: Updates that arrive this late are still looked for; repeats within it are dropped.
LOOK_BACK = "5 seconds"


@dataclass
class Refresh:
    """What a batch did: the snapshot's folder and whether it is new."""

    path: str
    changed: bool


@dataclass
class SnapshotStream:
    """Each micro-batch of a source is a whole table: stored by its content, and ``on_change`` runs for a new one."""

    root: str
    on_change: Callable[[DataFrame], None] | None = None
    log: list[Refresh] = field(default_factory=list)

    def take(self, batch: DataFrame, _: int = 0) -> None:
        path, changed = snapshot(batch, self.root)
        self.log.append(Refresh(path, changed))
        if changed and self.on_change:
            self.on_change(batch.sparkSession.read.parquet(path))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A query's checkpoint has one writer, so no second worker takes the same batch."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def carry_mapping(df: DataFrame, previous: clean.Mapping | None) -> clean.Mapping | None:
    """The previous mapping, if it still validates on every row of the new table."""
    if previous is None:
        return None
    try:
        return clean.validate(df, previous)
    except clean.MappingError:
        return None


def event_time(stream: DataFrame, time: str) -> DataFrame:
    """With ``time`` as an instant, which watermarks need; local times count in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")) if isinstance(stream.schema[time].dataType, T.TimestampNTZType) else stream


def cursor_now(df: DataFrame, time: str) -> str:
    """The cursor of a reader that starts now: after everything up to the latest update, before any later one."""
    latest = df.agg(F.max(time).cast("string")).first()[0]
    return f"{latest or '1970-01-01 00:00:00'}~\uffff~"


def updates(stream: DataFrame, time: str, *keys: str, look_back: str = LOOK_BACK) -> DataFrame:
    """Each update once: late ones within the look-back are kept, repeats by key dropped."""
    return event_time(stream, time).withWatermark(time, look_back).dropDuplicatesWithinWatermark([*keys])


def poll(df: DataFrame, cursor: str, time: str, kind: str, key: str, most: int = 100) -> DataFrame:
    """A page of stored updates after a ``time~kind~id`` cursor, in that order."""
    at, k, i = parse_cursor(cursor)
    place, after = F.struct(F.col(time), F.col(kind), F.col(key).cast("string")), F.struct(F.lit(at).cast(df.schema[time].dataType), F.lit(k), F.lit(i))
    return df.where(place > after).orderBy(time, kind, F.col(key).cast("string")).limit(most)


class Feed:
    """A reader of updates who sees each one once, late ones included.

    A page holds what comes after the cursor, and what arrived late: updates within ``look_back`` before it that this
    reader was not sent. What was sent is kept as keys in a folder, by generation, as long as the look-back reaches: the
    state's size is what arrives in that time, whatever the table's. Updates of one time, kind and key are one. A page ends
    at ``most`` updates in the order of time, kind and key, late ones first, so one that begins at its border is not lost
    and updates of one time may be parted by it.

    A page counts as sent when ``commit`` is called; until then ``poll`` gives it again. Updates without a time are none."""

    def __init__(self, spark: SparkSession, root: str, time: str, kind: str, key: str, look_back: str = LOOK_BACK, most: int = 100):
        self.spark, self.root, self.time, self.kind, self.key, self.look_back, self.most = spark, root.rstrip("/"), time, kind, key, look_back, most
        self.generation = 0
        self._page: DataFrame | None = None
        self._settled = False

    def _place(self) -> Column:
        return F.struct(F.col(self.time).alias("time"), F.col(self.kind).cast("string").alias("kind"), F.col(self.key).cast("string").alias("key"))

    def _back(self, cursor) -> Column:
        return F.lit(cursor) - F.expr(f"INTERVAL {self.look_back}")

    def start(self, df: DataFrame, cursor: str | None = None) -> None:
        """Begin after a ``time~kind~id`` cursor, or after all that is there: what stands before it counts as sent."""
        at, kind, key = parse_cursor(cursor or cursor_now(df, self.time))
        first = F.struct(F.lit(at).cast(df.schema[self.time].dataType).alias("time"), F.lit(kind).alias("kind"), F.lit(key).alias("key"))
        seen = df.where(F.col(self.time).isNotNull()).select(self._place().alias("place")).where((F.col("place") <= first) & (F.col("place.time") >= first["time"] - F.expr(f"INTERVAL {self.look_back}"))).distinct()
        mark = self.spark.range(1).select(first.alias("place"), F.lit(True).alias("cursor"))
        seen.select("place", F.lit(False).alias("cursor")).unionByName(mark).write.mode("overwrite").parquet(f"{self.root}/0")
        self.generation, self._page = 0, None

    def _state(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.generation}")

    def _fresh(self, df: DataFrame) -> DataFrame:
        """What was not sent, once each, with its ``_place``."""
        state = self._state()
        cursor = state.where("cursor").first()["place"]
        after = F.struct(F.lit(cursor["time"]).alias("time"), F.lit(cursor["kind"]).alias("kind"), F.lit(cursor["key"]).alias("key"))
        # The filter on time reaches the scan; the exact place is compared after it.
        recent = df.where(F.col(self.time) >= self._back(cursor["time"])).withColumn("_place", self._place())
        sent = state.where("NOT cursor").select(F.col("place").alias("_place"))
        fresh = recent.where(F.col("_place") > after).unionByName(recent.where(F.col("_place") <= after).join(sent, "_place", "left_anti").select(recent.columns))
        return fresh.dropDuplicates(["_place"])

    def poll(self, df: DataFrame) -> DataFrame:
        """The next page, oldest first."""
        self._page, self._settled = self._fresh(df).orderBy("_place").limit(self.most), False
        return self._page.drop("_place")

    def pages(self, df: DataFrame, name: str = "page") -> DataFrame:
        """All pages that ``poll`` and ``commit`` in turn would give of ``df`` as it is, numbered from 0 in the column ``name``.

        A page changes nothing for those after it but where they begin: late updates come first in the order of places,
        and the cursor passes them only when none is left. So the pages are stretches of ``most`` of one order, found in one
        pass however many they are. ``commit`` takes all of them as sent."""
        self._page, self._settled = number_rows(self._fresh(df), "_place", name="_nth"), True
        return self._page.withColumn(name, F.floor(F.col("_nth") / self.most)).drop("_place", "_nth")

    def commit(self) -> int:
        """Take the last page, or all ``pages``, as sent; the number of their updates."""
        page = self._page.select("_place")
        if not self._settled:
            page = self.spark.createDataFrame(page.collect(), page.schema)  # ``most`` rows
        state, rows = self._state(), page.count()
        if rows:
            cursor = state.where("cursor").first()["place"]
            last = page.agg(F.max("_place")).first()[0]
            last = max(last, cursor, key=lambda p: (p["time"], p["kind"], p["key"]))
            keep = state.where("NOT cursor").select("place").unionByName(page.select(F.col("_place").alias("place"))).where(F.col("place.time") >= self._back(last["time"])).distinct()
            mark = self.spark.createDataFrame([(last, True)], state.select("place", "cursor").schema)
            keep.select("place", F.lit(False).alias("cursor")).unionByName(mark).write.mode("overwrite").parquet(f"{self.root}/{self.generation + 1}")
            self.generation += 1
        self._page = None
        return rows


def parse_cursor(text: str | None) -> tuple[str, str, str]:
    """A cursor's parts; a malformed one starts from the end of time's first page: nothing old is sent again."""
    parts = (text or "").split("~")
    return (parts[0], parts[1], parts[2]) if len(parts) == 3 and parts[0] else ("9999-12-31 00:00:00", "", "")


def windowed(stream: DataFrame, time: str, value: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: totals by tumbling event-time window and group."""
    return event_time(stream, time).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of a group's events that are less than ``gap`` apart."""
    return events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
