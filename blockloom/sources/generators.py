"""Generated inputs of the round-trip harness and of the table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **ranges: range) -> DataFrame:
    """Every combination of values of small ranges, a column for each: their number is a product of literals."""
    n = 1
    for r in ranges.values():
        n *= len(r)
    out, left = spark.range(n), n
    for name, r in ranges.items():
        left //= len(r)
        out = out.withColumn(name, F.pmod(F.floor(F.col("id") / left), F.lit(len(r))) * r.step + r.start)
    return out.drop("id")


def one_colour(spark: SparkSession) -> DataFrame:
    """(channel, value, r, g, b): three channels by values 0 to 254, the other channels 0."""
    return with_channels(grid(spark, channel=range(3), value=range(255)), "value")


def one_colour_random(spark: SparkSession, n: int = 1000) -> DataFrame:
    """(test, r, g, b): n colours by a fixed linear congruence, so that any engine draws the same."""
    x = lambda k: F.pmod((F.col("test") * 3 + k + 1) * 1103515245 + 12345, F.lit(1 << 31))
    drawn = spark.range(n).withColumnRenamed("id", "test")
    return drawn.select("test", *[F.pmod(F.floor(x(k) / 65536), F.lit(256)).alias(c) for k, c in enumerate("rgb")])


def two_colours(spark: SparkSession) -> DataFrame:
    """(channel, v1, v2) with v1 < v2 < 255; the first half of a block has v1, the second v2."""
    return grid(spark, channel=range(3), v1=range(255), v2=range(255)).where("v1 < v2")


def with_channels(df: DataFrame, value: str) -> DataFrame:
    return df.select("*", *[F.when(F.col("channel") == k, F.col(value)).otherwise(0).alias(c) for k, c in enumerate("rgb")])


def directions(spark: SparkSession) -> DataFrame:
    """(x, y, z): the half cube in steps of an eighth, without its centre."""
    steps = grid(spark, i=range(-8, 9), j=range(-8, 9), k=range(0, 9)).where("not (i = 0 and j = 0 and k = 0)")
    return steps.select(*[(F.col(c) / 8.0).alias(n) for c, n in (("i", "x"), ("j", "y"), ("k", "z"))])
