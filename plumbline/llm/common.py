"""What the corpus operators share: word rules, text cleaning and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Without it a local session uses one temporary folder, any other session its warehouse.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Lost executors cost at most the tasks that had not ended: the files are in no executor's own folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *columns: Column, without: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns under neutral names, so that no name of theirs meets one of an operator's own, beside
    ``columns``, which are read from ``docs`` itself; and the names. Unused columns are still pruned from the scan."""
    own = [c for c in docs.columns if c not in without]
    return docs.select(*[docs[f"`{c}`"].alias(f"_own{i}") for i, c in enumerate(own)], *columns), own


def unpacked(own: Sequence[str]) -> list[Column]:
    return [F.col(f"_own{i}").alias(c) for i, c in enumerate(own)]


def held(own: Sequence[str]) -> list[str]:
    """The neutral names."""
    return [f"_own{i}" for i in range(len(own))]


def integer_id(docs: DataFrame, *keys: str) -> None:
    """Refuse ids that are no integers, before any job runs."""
    for key in keys:
        if not isinstance(docs.schema[key].dataType, T.IntegralType):
            raise TypeError(f"{key} is {docs.schema[key].dataType.simpleString()}; an integer column is needed")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def hash_60(*cols: Column) -> Column:
    """A non-negative 60-bit hash that any engine with md5 can reproduce; a null counts as an empty string."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``most`` bytes of text, one row at least, so that work arrays stay small."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at = held = 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)
