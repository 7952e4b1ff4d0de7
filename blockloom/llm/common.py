"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: what parts words. Python's bytes.split() uses the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a local one where none is set."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "blockloom-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor depend on executors' disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    if OPEN:
        OPEN[-1].append(found)
    return found


#: Tables stored within scratch blocks that are open.
OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """At its end, tables that were stored within are deleted, but for those handed to what it gives (keep)."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    OPEN.append([])
    try:
        yield keep
    finally:
        made = OPEN.pop()
        removed(*[t for t in made if not any(t is k for k in kept)])
        if OPEN:
            OPEN[-1].extend(kept)


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def set_aside(docs: DataFrame, *known: str) -> DataFrame:
    """docs with all columns but the known ones under names that clash with none; toDF(*docs.columns) gives them back."""
    return docs.toDF(*[c if c in known else f"__{k}" for k, c in enumerate(docs.columns)])


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, the shuffle files of each finished query go at once instead of whenever the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false where the key is null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def batch(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    """A record batch of these columns, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> Iterator[str]:
    """Each text of a binary or string column; null becomes the empty text, malformed bytes the replacement character."""
    for x in column.to_pylist():
        yield x if isinstance(x, str) else (x or b"").decode("utf-8", "replace")


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """The stored table with a row id that stays, as it is written along with the rows."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Stores df with the 1-based place of each row within its group.

    Rows are dealt by range over keys and order, so that a group of any size spreads over tasks; a row's place is its
    place within its task plus what earlier tasks hold of the group. The table of those offsets has a row per task
    and group that meet.
    """
    nulls_last = [F.col(k).asc_nulls_last() for k in keys]
    dealt = df.repartitionByRange(*nulls_last, *order).sortWithinPartitions(*nulls_last, *order)
    kept = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    kept = kept.withColumn("_task", F.shiftright("_at", 33))
    met = kept.groupBy("_task", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.select(F.col("_task").alias("_t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_task") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return kept.join(met, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
