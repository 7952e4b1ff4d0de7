"""Keys of any size in blocks of 16: ranges of a key against one sort of it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.plans.scale import in_blocks


def plain(rows, key, order):
    """One window per key."""
    n = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    each = rows.withColumn("_n", n).withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    return each.where(F.col("_n") < 16 * F.floor(F.col("_all") / 16)).select(*rows.columns, F.floor(F.col("_n") / 16).alias("block"), F.pmod("_n", F.lit(16)).alias("texel"))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_a_hot_key_is_dealt_to_ranges(spark):
    # key 0 has most rows, some times are shared by many rows, nulls and what is no number among them; one key is null
    at = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, F.lit(float("nan"))).otherwise(F.floor(F.pmod(F.xxhash64("id"), F.lit(5000)) / 10).cast("double"))
    key = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, F.col("id") % 11).otherwise(0)
    rows = spark.range(6000).select(key.alias("k"), at.alias("t"), "id")
    expected = found(plain(rows, "k", ["t", "id"]))
    for n in (1, 2, 9):
        got = in_blocks(rows, "k", ["t", "id"], n)
        assert got.columns == ["k", "t", "id", "block", "texel"]
        assert found(got) == expected
    assert {r.split(",")[0] for r in expected} > {"(None", "(0"}


def test_few_rows_and_none(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.lit(None).cast("timestamp").alias("t"), "id")
    assert found(in_blocks(rows, "k", ["t", "id"], 4)) == found(plain(rows, "k", ["t", "id"]))
    times = rows.withColumn("t", F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz"))
    assert found(in_blocks(times, "k", ["t", "id"], 4)) == found(plain(times, "k", ["t", "id"]))
    assert in_blocks(rows.where("false"), "k", ["t", "id"], 4).collect() == []
    assert in_blocks(rows.where("id < 15"), "k", ["t", "id"], 4).collect() == []
