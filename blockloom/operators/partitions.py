"""Partitions of a block's 16 texels in two or three subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, by partition 0 to 63: a bit per texel (texel 0 lowest), set for subset 1.
TWO = (
    0xCCCC, 0x8888, 0xEEEE, 0xECC8, 0xC880, 0xFEEC, 0xFEC8, 0xEC80, 0xC800, 0xFFEC, 0xFE80, 0xE800, 0xFFE8, 0xFF00, 0xFFF0, 0xF000,
    0xF710, 0x008E, 0x7100, 0x08CE, 0x008C, 0x7310, 0x3100, 0x8CCE, 0x088C, 0x3110, 0x6666, 0x366C, 0x17E8, 0x0FF0, 0x718E, 0x399C,
    0xAAAA, 0xF0F0, 0x5A5A, 0x33CC, 0x3C3C, 0x55AA, 0x9696, 0xA55A, 0x73CE, 0x13C8, 0x324C, 0x3BDC, 0x6996, 0xC33C, 0x9966, 0x0660,
    0x0272, 0x04E4, 0x4E40, 0x2720, 0xC936, 0x936C, 0x39C6, 0x639C, 0x9336, 0x9CC6, 0x817E, 0xE718, 0xCCF0, 0x0FCC, 0x7744, 0xEE22,
)
#: Subset 2 in the high 16 bits, subset 1 in the low ones.
THREE = (
    0xF60008CC, 0x73008CC8, 0x3310CC80, 0x00CEEC00, 0xCC003300, 0xCC0000CC, 0x00CCFF00, 0x3300CCCC, 0xF0000F00, 0xF0000FF0, 0xFF0000F0, 0x88884444, 0x88886666, 0xCCCC2222, 0xEC80136C, 0x7310008C,
    0xC80036C8, 0x310008CE, 0xCCC03330, 0x0CCCF000, 0xEE0000EE, 0x77008888, 0xCC0022C0, 0x33004430, 0x00CC0C22, 0xFC880344, 0x06606996, 0x66009960, 0xC88C0330, 0xF9000066, 0x0CC0C22C, 0x73108C00,
    0xEC801300, 0x08CEC400, 0xEC80004C, 0x44442222, 0x0F0000F0, 0x49242492, 0x42942942, 0x0C30C30C, 0x03C0C03C, 0xFF0000AA, 0x5500AA00, 0xCCCC3030, 0x0C0CC0C0, 0x66669090, 0x0FF0A00A, 0x5550AAA0,
    0xF0000AAA, 0x0E0EE0E0, 0x88887070, 0x99906660, 0xE00E0EE0, 0x88880770, 0xF0000666, 0x99006600, 0xFF000066, 0xC00C0CC0, 0xCCCC0330, 0x90006000, 0x08088080, 0xEEEE1010, 0xFFF0000A, 0x731008CE,
)
#: Fixed values, by partition: the texels besides 0 whose index is a bit shorter, of subset 1 of two, and of subsets 1 and 2 of three.
ANCHORS_TWO = (15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2, 15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15)
ANCHORS_THREE_1 = (3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15, 8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3)
ANCHORS_THREE_2 = (15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8, 15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8)


def masks(spark: SparkSession) -> DataFrame:
    """(subsets, partition, mask)."""
    rows = [F.struct(F.lit(n).cast("long").alias("subsets"), F.lit(p).cast("long").alias("partition"), F.lit(m).cast("long").alias("mask")) for n, some in ((2, TWO), (3, THREE)) for p, m in enumerate(some)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def members(spark: SparkSession) -> DataFrame:
    """(subsets, partition, texel, subset): every texel lies in one subset of each partition."""
    bit = lambda k: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), F.col("texel") + k)), F.lit(2))
    each = masks(spark).withColumn("texel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return each.select("subsets", "partition", "texel", F.when((F.col("subsets") == 3) & (bit(16) == 1), 2).otherwise(bit(0)).cast("long").alias("subset"))


def first_texels(spark: SparkSession) -> DataFrame:
    return members(spark).groupBy("subsets", "partition", "subset").agg(F.min("texel").alias("first"), F.count("*").alias("texels"))


def anchors(spark: SparkSession) -> DataFrame:
    """(subsets, partition, subset, anchor): subset 0's is texel 0."""
    kinds = ((2, 1, ANCHORS_TWO), (3, 1, ANCHORS_THREE_1), (3, 2, ANCHORS_THREE_2), (2, 0, (0,) * 64), (3, 0, (0,) * 64))
    rows = [F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("subsets", "partition", "subset", "anchor"), (n, p, s, t))]) for n, s, some in kinds for p, t in enumerate(some)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def byte_masks(spark: SparkSession) -> DataFrame:
    """(subsets, partition, subset, row, mask): a byte of ones for each texel of the subset, four texels to a word."""
    each = members(spark).withColumn("row", F.floor(F.col("texel") / 4))
    return each.groupBy("subsets", "partition", "subset", "row").agg(F.sum(F.pow(F.lit(256.0), F.pmod("texel", F.lit(4))).cast("long") * 255).alias("mask"))
