"""The analysis table: a DataFrame with its measure columns, roles and row order."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ROW = "_row_id"

_own_folder: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Where files of a run go: ``spark.checkpoint.dir``, which driver and executors share; a session without one gets
    a temporary folder if it is local, else its warehouse."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _own_folder[app]



@dataclass
class AnalysisTable:
    """Measures are doubles (null if blank), other columns text (blank is ""). ``order`` lists the columns whose
    order is the rows' order; files get ``_row_id`` on reading, Parquet tables name their own key."""

    df: DataFrame
    numeric: frozenset[str]
    order: tuple[str, ...] = (ROW,)
    roles: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, order: tuple[str, ...], roles: dict[str, str] | None = None) -> AnalysisTable:
        numeric = frozenset(f.name for f in df.schema if isinstance(f.dataType, NumericType))
        return cls(df, numeric, order, roles or {})

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def with_df(self, df: DataFrame) -> AnalysisTable:
        return AnalysisTable(df, self.numeric, self.order, self.roles)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the session's checkpoint folder, which outlives lost executors, or in memory where a
    session has none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def running_sums(df: DataFrame, value: Column, *order: Column, place: str, total: str) -> DataFrame:
    """A place from 1 and the running sum of a decimal ``value``, in the order given, without one task that sorts all
    rows: each range adds up its own rows, and one row a range carries what stands before it."""
    dealt = settled(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    before = sizes.select("_part", (F.sum("_n").over(so_far) - F.col("_n")).alias("_n"), (F.sum("_sum").over(so_far) - F.col("_sum")).alias("_sum"))
    own = Window.partitionBy("_part").orderBy(*order)
    upto = F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dealt.withColumns({place: F.row_number().over(own), total: upto}).join(F.broadcast(before), "_part")
    return out.withColumns({place: F.col(place) + F.col("_n"), total: F.col(total) + F.col("_sum")}).drop("_part", "_n", "_sum", "_value")


def number_rows(df: DataFrame, *order: Column | str, name: str = ROW) -> DataFrame:
    """A consecutive number from 0 in the order of the given columns, without one task that sorts all rows.

    The rows are range-partitioned; each partition numbers its own and adds the sizes of those before it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    dealt = settled(dealt)  # both readers must see one and the same partitioning
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    return dealt.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
