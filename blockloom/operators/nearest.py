"""Nearest hits: for each value, the greatest hit that is not above it and the least that is not below it."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bins(values: DataFrame, column: str, n: int) -> list[float]:
    """At most n - 1 splits that part the values about evenly, for Bucketizer; equal ones once."""
    found = values.approxQuantile(column, [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    return [float("-inf"), *(sorted({x for x in found if math.isfinite(x)}) or [0.0]), float("inf")]


def in_bins(rows: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    return Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(rows)


def nearest_hits(rows: DataFrame, hits: DataFrame, key: str, value: str, n: int | None = None) -> DataFrame:
    """The rows with below and above: of the hits (key, value) of their key, the nearest on either side, itself on both.

    Each pair of key and value is looked up once, however many rows have it. Values are dealt to ranges, so that a key of
    any size spreads over tasks; each range of a key is sorted by itself, and what lies beyond its edges comes from one row for
    each range. n is the number of ranges, by default that of shuffle partitions. Values are doubles; a row without key, or
    whose value is null or no number, and a key without hits, give nulls; such hits count for nothing. Rows keep their
    number and all their columns, but none may be called below or above.
    """
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = lambda d, hit: d.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"), F.lit(hit).alias("_hit"))
    every = some(rows, False).unionByName(some(hits, True)).where(F.col("_key").isNotNull() & F.col("_value").isNotNull() & ~F.isnan("_value"))
    points = in_bins(every.groupBy("_key", "_value").agg(F.max("_hit").alias("_hit")), "_value", bins(every, "_value", n), "_bin")
    hit = F.when(F.col("_hit"), F.col("_value"))
    own = Window.partitionBy("_key", "_bin")
    up, down = own.orderBy("_value"), own.orderBy(F.desc("_value"))
    near = points.withColumn("_below", F.last(hit, True).over(up)).withColumn("_above", F.last(hit, True).over(down))
    # one row for each range of a key: at most n of them, so that their windows are short
    edges = points.groupBy("_key", "_bin").agg(F.min(hit).alias("_least"), F.max(hit).alias("_most"))
    by = Window.partitionBy("_key")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_key", "_bin", F.max("_most").over(past(by.orderBy("_bin"))).alias("_before"), F.min("_least").over(past(by.orderBy(F.desc("_bin")))).alias("_after"))
    found = near.join(edges, ["_key", "_bin"]).select("_key", "_value", F.coalesce("_below", "_before").alias("below"), F.coalesce("_above", "_after").alias("above"))
    met = rows.join(found, (F.col(key) == F.col("_key")) & (F.col(value).cast("double") == F.col("_value")), "left")
    return met.drop("_key", "_value")
