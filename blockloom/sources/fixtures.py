"""The analytics' inputs from the test tables: an embedding of 64 numbers is a block of 16 RGBA texels, or 64 bytes of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, e): one block per row, its 64 channel values of 0 to 255 in an array."""
    u8 = lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 1) * 127.5 + 0.5).cast("double"))).cast("long")
    return embeddings(spark, d).select("vec_id", "label", F.transform("embedding", u8).alias("e"))


def texels(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, texel, r, g, b, a)."""
    t = F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))
    at = lambda k: F.element_at("e", (F.col("texel") * 4 + k + 1).cast("int"))
    return blocks(spark, d).withColumn("texel", F.explode(t)).select("vec_id", "label", "texel", at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), at(3).alias("a"))


def codes(spark: SparkSession, d: str, size: int) -> DataFrame:
    """(vec_id, block, c): compressed blocks of so many bytes, 64 bytes from each embedding's low digits."""
    return coded(embeddings(spark, d), size)


def coded(vectors: DataFrame, size: int) -> DataFrame:
    byte = lambda x: F.pmod(F.floor((x.cast("double") + 1) * 1048576), F.lit(256)).cast("long")
    each = vectors.select("vec_id", F.transform("embedding", byte).alias("e"))
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(64 // size - 1).cast("long"))))
    return each.select("vec_id", "block", F.slice("e", (F.col("block") * size + 1).cast("int"), size).alias("c"))


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of numbers."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(F.length(latin) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(latin, ""), lambda c: F.ascii(c).cast("long")))


def numbers(code: Column, size: int) -> Column:
    """So many bytes, a multiple of four, as an array of numbers: four at a time, as parts of one number."""
    words = [F.conv(F.hex(F.substring(code, 4 * k + 1, 4)), 16, 10).cast("long") for k in range(size // 4)]
    return F.array(*[F.shiftright(w, s).bitwiseAND(F.lit(255).cast("long")) for w in words for s in (24, 16, 8, 0)])


def dealt(rows: DataFrame) -> DataFrame:
    """A table that may be read in fewer tasks than can run at once, dealt out evenly: a file of one row group is one task's, whatever its size."""
    tasks, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows if min(parts, len(rows.inputFiles())) >= tasks else rows.repartition(max(tasks, parts))


def text_blocks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(vec_id, block, c): each text's UTF-8 bytes in whole blocks of so many bytes; what remains is left out."""
    each = dealt(rows.where(F.octet_length(text) >= size).select(key, text)).select(F.col(key).alias("vec_id"), F.encode(F.col(text), "UTF-8").alias("b"), F.floor(F.octet_length(text) / size).alias("n"))
    # blocks are cut within the row, so that no row carries the whole text's bytes along
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.substring("b", (k * size + 1).cast("int"), F.lit(size)))
    return each.select("vec_id", F.posexplode(own).alias("block", "c")).select("vec_id", F.col("block").cast("long").alias("block"), "c")


def text_codes(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The same, with the bytes as arrays of numbers."""
    return text_blocks(rows, key, text, size).select("vec_id", "block", numbers(F.col("c"), size).alias("c"))


def sql_bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def sql_text_codes(table: str, key: str, text: str, size: int) -> str:
    chunk = ", ".join(f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS BIGINT)" for i in range(size))
    return f"raw AS (SELECT {key} AS vec_id, unnest(regexp_extract_all(hex(encode({text})), '.{{{2 * size}}}')) AS h, unnest(range(strlen({text}) // {size})) AS block FROM {table} WHERE strlen({text}) >= {size}), cod AS (SELECT vec_id, block, [{chunk}] AS c FROM raw)"


SQL_BLOCKS = "blk AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5 + 0.5))) AS BIGINT)) AS e FROM embeddings)"
SQL_TEXELS = SQL_BLOCKS + ", tex AS (SELECT vec_id, label, t AS texel, e[4*t+1] AS r, e[4*t+2] AS g, e[4*t+3] AS b, e[4*t+4] AS a FROM blk, range(16) s(t))"


def sql_codes(size: int) -> str:
    return f"raw AS (SELECT vec_id, list_transform(embedding, lambda x: (CAST(floor((CAST(x AS DOUBLE) + 1) * 1048576) AS BIGINT) % 256 + 256) % 256) AS e FROM embeddings), cod AS (SELECT vec_id, k AS block, list_slice(e, k*{size}+1, k*{size}+{size}) AS c FROM raw, range({64 // size}) s(k))"
