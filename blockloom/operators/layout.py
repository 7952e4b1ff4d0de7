"""Sizes, addresses and tilings of block-compressed images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.channels import number


def up(x: Column, k: int) -> Column:
    return F.ceil(x / k)


def sizes(w: Column, h: Column) -> dict[str, Column]:
    """Bytes of an image in each format."""
    blocks = up(w, 4) * up(h, 4)
    return {
        "s3tc_8": blocks * 8, "s3tc_16": blocks * 16, "fxt1": up(w, 8) * up(h, 4) * 16, "atc_8": blocks * 8, "atc_16": blocks * 16,
        "pvrtc_4bpp": F.floor(F.greatest(w, number(8)) * F.greatest(h, number(8)) * 4 / 8), "pvrtc_2bpp": F.floor(F.greatest(w, number(16)) * F.greatest(h, number(8)) * 2 / 8),
    }


def volume_size(w: Column, h: Column, d: Column, size: int) -> Column:
    """Bytes of a volume of blocks of so many bytes for each layer."""
    return up(w, 4) * up(h, 4) * d * size


def volume_block(w: Column, h: Column, d: Column, x: Column, y: Column, z: Column, size: int) -> Column:
    """Offset of the block of a texel in a volume: slices stacked by four, what remains one by one."""
    across, down, stacked = up(w, 4), up(h, 4), 4 * F.floor(d / 4)
    bx, by = F.floor(x / 4), F.floor(y / 4)
    rest = size * (across * down * stacked + bx + across * (by + down * (z - stacked)))
    return F.when(z >= stacked, rest).otherwise(size * 4 * (bx + across * (by + down * F.floor(z / 4))))


def update_is_legal(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Part of an image that may be replaced: it starts on blocks, and its sides are whole blocks or reach the edge."""
    return (F.pmod(x, F.lit(4)) == 0) & (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(w, F.lit(4)) == 0) | (x + w == width)) & ((F.pmod(h, F.lit(4)) == 0) | (y + h == height))


def normalised(df: DataFrame, channels: Column, values: list[Column]) -> DataFrame:
    """r, g, b, a from 1 to 4 channels: grey fills three, a missing alpha is 255."""
    grey = channels <= 2
    out = [values[0], F.when(grey, values[0]).otherwise(values[1]), F.when(grey, values[0]).otherwise(values[2])]
    alpha = F.when(channels == 2, values[1]).when(channels == 4, values[3]).otherwise(number(255))
    return df.withColumns(dict(zip("rgba", [*out, alpha])))


def tiled(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pixels (keys, x, y, value) as blocks: block_y, block_x and 16 values, row by row. Refuses sides that are no multiple of 4."""
    each = pixels.withColumns({"block_x": F.floor(F.col("x") / 4), "block_y": F.floor(F.col("y") / 4), "texel": 4 * F.pmod("y", F.lit(4)) + F.pmod("x", F.lit(4))})
    found = each.groupBy(*keys, "block_y", "block_x").agg(F.transform(F.array_sort(F.collect_list(F.struct("texel", value))), lambda s: s[value]).alias("texels"))
    whole = F.when(F.size("texels") == 16, F.col("texels")).otherwise(F.raise_error(F.lit("width and height must be multiples of 4")))
    return found.withColumn("texels", whole)


def untiled(blocks: DataFrame, keys: list[str], value: str) -> DataFrame:
    each = blocks.select(*keys, "block_y", "block_x", F.posexplode("texels").alias("texel", value))
    return each.select(*keys, (F.col("block_x") * 4 + F.pmod("texel", F.lit(4))).alias("x"), (F.col("block_y") * 4 + F.floor(F.col("texel") / 4)).alias("y"), value)
