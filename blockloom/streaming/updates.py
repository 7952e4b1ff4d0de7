"""Updates of parts of block-compressed images, applied as they come: the current block is the state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import layout

#: What an update is: its image, its place in time (ts, then seq), the part that it replaces, and what it puts there.
UPDATE = ["image", "ts", "seq", "x", "y", "w", "h", "code"]
CURRENT = "image long, block long, at long, seq long, code long, updates long"
#: The state lies on disk. What an update's part is gets repeated by each of the conditions on it; as one method that is longer
#: than the JVM compiles (8000 bytes), so that such stages are left to shorter ones.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.codegen.hugeMethodLimit": "8000"}


def legal(width: int, height: int):
    """Parts that lie within the image, start on blocks, and have whole blocks or reach the edge; nothing of them is null."""
    x, y, w, h = (F.col(c) for c in "xywh")
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)
    known = F.col("image").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull() & F.col("code").isNotNull()
    return F.coalesce(known & inside & layout.update_is_legal(x, y, w, h, F.lit(width), F.lit(height)), F.lit(False))


def touched(updates: DataFrame, width: int, height: int) -> DataFrame:
    """(image, block, at, seq, code): a row for each block that a legal update replaces, at in microseconds; blocks are numbered row by row."""
    blocks = lambda n: F.shiftright(F.col(n) + 3, 2)
    each = updates.where(legal(width, height)).select("image", F.unix_micros("ts").alias("at"), "seq", "code", F.shiftright("x", 2).alias("bx"), F.shiftright("y", 2).alias("by"), blocks("w").alias("across"), blocks("h").alias("down"))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") * F.col("down") - 1)))
    row, column = F.col("by") + F.expr("k div across"), F.col("bx") + F.pmod("k", "across")
    return each.select("image", (row * -(-width // 4) + column).cast("long").alias("block"), "at", "seq", "code")


def latest(touched: DataFrame) -> DataFrame:
    """(image, block, at, seq, code, updates): each block's latest update in time, and how many there were.

    On a stream this is what Spark keeps as state: a task's rows of a block are one before they meet it, and what comes late
    changes the count alone. Of updates alike in time and place the greatest code stays.
    """
    each = touched.groupBy("image", "block").agg(F.max(F.struct("at", "seq", "code")).alias("x"), F.count("*").alias("updates"))
    return each.select("image", "block", "x.at", "x.seq", "x.code", "updates")


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(changed: DataFrame, batch: int, out: str) -> None:
    """A batch's changed blocks; a batch that runs again puts the same in their place."""
    changed.write.mode("overwrite").parquet(f"{out}/versions/batch={batch}")


def apply_available(updates: DataFrame, width: int, height: int, out: str) -> tuple[DataFrame, DataFrame]:
    """Applies all that a stream of updates holds now; (current blocks, refused updates) as they stand after it.

    Blocks are the keys, so that an image that many updates touch spreads over tasks. The state goes on from the
    checkpoint below out when this is called again, or after a failure. Each batch writes the blocks that it changed;
    the version with the most updates is the current one. Illegal updates go to a table of their own.
    """
    spark = updates.sparkSession
    with settings(spark, SETTINGS):
        kept = latest(touched(updates, width, height)).writeStream.outputMode("update").foreachBatch(lambda df, n: written(df, n, out))
        refused = updates.where(~legal(width, height)).writeStream.format("parquet").option("path", f"{out}/refused")
        for name, query in (("versions", kept), ("refused", refused)):
            query.option("checkpointLocation", f"{out}/progress-{name}").trigger(availableNow=True).start().awaitTermination()
    return current(spark, out), spark.read.schema(updates.schema).parquet(f"{out}/refused")


def current(spark: SparkSession, out: str) -> DataFrame:
    """(image, block, ts, seq, code, updates): the blocks as they stand."""
    versions = spark.read.schema(f"{CURRENT}, batch long").parquet(f"{out}/versions")
    if len({f.split("/batch=")[1].split("/")[0] for f in versions.inputFiles()}) == 1:  # one batch has each block once
        return versions.select("image", "block", F.timestamp_micros("at").alias("ts"), "seq", "code", "updates")
    last = F.max_by(F.struct("at", "seq", "code"), "updates").alias("x")
    return versions.groupBy("image", "block").agg(last, F.max("updates").alias("updates")).select("image", "block", F.timestamp_micros("x.at").alias("ts"), "x.seq", "x.code", "updates")
