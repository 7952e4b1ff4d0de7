"""The operators over the large tables: texts and pages as compressed blocks, events and lineitem as values and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.operators import census, decode, errors
from blockloom.operators.nearest import bins, in_bins
from blockloom.plans import blocks
from blockloom.plans.census import _error
from blockloom.sources import fixtures

#: Query -> (table, key, text, bytes of a block, decoder, texels of a block).
CODED = {
    "scale_dec1_documents": ("documents", "doc_id", "text", 8, lambda c: decode.bc1(c, False), 16), "scale_dec7_documents": ("documents", "doc_id", "text", 8, decode.etc1, 16),
    "scale_dec4_pages": ("pages", "page_id", "html", 16, decode.bc3, 16), "scale_dec8_pages": ("pages", "page_id", "html", 16, decode.fxt1, 32),
}


def summed(name: str):
    """All whole blocks of each row's bytes, decoded: how many texels, and what each channel sums up to by place."""
    source, key, text, size, decoder, _ = CODED[name]

    def run(spark, d):
        rows = spark.read.parquet(f"{d}/{source}.parquet").select(key, text)
        found = decoder(fixtures.text_codes(rows, key, text, size))
        return found.groupBy("vec_id").agg(F.count("*").alias("texels"), *[F.sum(F.col(c) * (F.col("texel") + 1)).alias(f"sum_{c}") for c in "rgba"])

    return run


def summed_sql(name: str, decoder_sql: str) -> str:
    source, key, text, size, _, _ = CODED[name]
    own = decoder_sql.replace(fixtures.sql_codes(size), fixtures.sql_text_codes(source, key, text, size))
    return f"SELECT vec_id, count(*) AS texels, {', '.join(f'CAST(sum({c} * (texel + 1)) AS BIGINT) AS sum_{c}' for c in 'rgba')} FROM ({own}) GROUP BY vec_id"


def in_blocks(rows: DataFrame, key: str, order: list[str], n: int | None = None) -> DataFrame:
    """Rows of each key in order, by 16: block and texel, without what is left over.

    Rows are dealt to ranges of the first column of the order, a number or a time, so that a key of any size spreads over
    tasks: each range of a key is sorted by itself, and how many rows of its key lie in ranges before it comes from one row
    for each range. n is the number of ranges, by default that of shuffle partitions. Rows that share key and first column
    are sorted together. A null key is a key like any other; in the order nulls come first.
    """
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col(order[0])
    if rows.schema[order[0]].dataType.typeName() == "timestamp_ntz":  # has no cast to numbers
        first = first.cast("timestamp")
    first = first.cast("double")
    first = F.when(first.isNull(), float("-inf")).when(F.isnan(first), float("inf")).otherwise(first)
    each = rows.withColumn("_first", first).withColumn("_key", F.struct(key))  # a struct is never null, so that null keys join as well
    each = in_bins(each, "_first", bins(each, "_first", n), "_bin").drop("_first")
    near = each.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_bin").orderBy(*order)).cast("long") - 1)
    by = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_held").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = each.groupBy("_key", "_bin").agg(F.count("*").alias("_held")).select("_key", "_bin", before.alias("_before"), F.sum("_held").over(by).alias("_all"))
    at = F.col("_n") + F.col("_before")
    met = near.join(edges, ["_key", "_bin"]).where(at < 16 * F.floor(F.col("_all") / 16))
    return met.select(*rows.columns, F.floor(at / 16).alias("block"), F.pmod(at, F.lit(16)).alias("texel"))


def pixel_errors(spark, d):
    """Line items as pixels, by supplier in blocks of 16: the error of RGB565 truncation."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    own: Column = lambda c: F.pmod(c, F.lit(256)).cast("long")
    each = in_blocks(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "block", own("l_partkey").alias("r"), own("l_suppkey").alias("g"), own("l_orderkey").alias("b"))
    each = each.select("*", *[ch.truncated(F.col(c), w).alias(f"{c}_q") for c, w in (("r", 5), ("g", 6), ("b", 5))])
    found = errors.block_error(each, ["l_suppkey", "block"], blocks.PAIRS)
    return found.groupBy("l_suppkey").agg(F.count("*").alias("n_blocks"), F.min("error").alias("least"), F.max("error").alias("most"), F.avg("error").alias("mse"))


def event_levels(spark, d):
    """Events as values of one channel, by user in blocks of 16: ends and error to the nearest of eight levels."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.floor(F.least(F.col("value"), F.lit(510.0)) / 2).cast("long").alias("v"))
    each = in_blocks(rows, "user_id", ["ts", "event_id"]).groupBy("user_id", "block").agg(F.collect_list("v").alias("values"))
    return census.nearest_level_error(each, ["user_id", "block"])


def event_search(spark, d):
    """The same blocks: the ends that the tangent search finds."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.floor(F.least(F.col("value"), F.lit(510.0)) / 2).cast("long").alias("v"))
    each = in_blocks(rows, "user_id", ["ts", "event_id"]).groupBy("user_id", "block").agg(F.collect_list("v").alias("values"))
    return census.best_parts(each, ["user_id", "block"], 2)


_n = "row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1 AS n, count(*) OVER (PARTITION BY {0}) AS whole"
_events = f"ev AS (SELECT user_id, CAST(floor(least(value, 510.0::DOUBLE) / 2) AS BIGINT) AS v, {_n.format('user_id', 'ts, event_id')} FROM events), q AS (SELECT user_id, n // 16 AS block, min(v) AS s, max(v) AS e, list(v) AS vs FROM ev WHERE n < 16 * (whole // 16) GROUP BY user_id, n // 16)"

QUERIES = {**{name: summed(name) for name in CODED}, "scale_agg1_lineitem": pixel_errors, "scale_agg8_events": event_levels, "scale_win3_events": event_search}
SQL = {
    "scale_dec1_documents": summed_sql("scale_dec1_documents", blocks.SQL["dec1_bc1_rgb"]), "scale_dec7_documents": summed_sql("scale_dec7_documents", blocks.SQL["dec7_etc1"]),
    "scale_dec4_pages": summed_sql("scale_dec4_pages", blocks.SQL["dec4_bc3"]), "scale_dec8_pages": summed_sql("scale_dec8_pages", blocks.SQL["dec8_dec11_fxt1"]),
    "scale_agg1_lineitem": f"""WITH px AS (SELECT l_suppkey, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b, {_n.format('l_suppkey', 'l_orderkey, l_linenumber, l_partkey')} FROM lineitem), qt AS (SELECT *, n // 16 AS block, {', '.join(f'{blocks._q(c, w)} AS {c}_q' for c, w in (('r', 5), ('g', 6), ('b', 5)))} FROM px WHERE n < 16 * (whole // 16)),
    er AS (SELECT l_suppkey, block, CAST(sum({blocks.SQ}) AS DOUBLE) / 16 AS error FROM qt GROUP BY l_suppkey, block) SELECT l_suppkey, count(*) AS n_blocks, min(error) AS least, max(error) AS most, avg(error) AS mse FROM er GROUP BY l_suppkey""",
    "scale_agg8_events": f"WITH {_events} SELECT user_id, block, s, e, {_error('s', 'e')} AS error FROM q",
    "scale_win3_events": f"""WITH {_events}, u AS (SELECT user_id, block, list_transform(range(17), lambda k: coalesce(list_sum(list_sort(vs)[1:k]), 0)::BIGINT) AS upto FROM q),
    g AS (SELECT user_id, block, c1, CASE WHEN c1 > 0 THEN CAST(upto[c1 + 1] * upto[c1 + 1] AS DOUBLE) / c1 ELSE 0 END + CASE WHEN c1 < 16 THEN CAST((upto[17] - upto[c1 + 1]) * (upto[17] - upto[c1 + 1]) AS DOUBLE) / (16 - c1) ELSE 0 END AS gain FROM u, range(17) s(c1))
    SELECT user_id, block, c1, gain FROM (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY gain DESC, c1) AS o FROM g) WHERE o = 1""",
}
