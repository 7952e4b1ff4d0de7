"""Errors between blocks and between images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared(*pairs: tuple[Column, Column]) -> Column:
    return sum((a - b) * (a - b) for a, b in pairs)


def block_error(texels: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Sum of squared differences over a block's 16 texels and the given channels, over 16."""
    each = squared(*[(F.col(a), F.col(b)) for a, b in pairs])
    return texels.groupBy(*keys).agg((F.sum(each) / 16).alias("error"))


def image_rms(a: DataFrame, b: DataFrame, keys: list[str], channels: str) -> DataFrame:
    """Root of the mean squared error per pixel of two images met by place; every channel that both have counts."""
    both = a.join(b.select(*keys, "x", "y", *[F.col(c).alias(f"other_{c}") for c in channels]), [*keys, "x", "y"])
    each = squared(*[(F.col(c), F.col(f"other_{c}")) for c in channels])
    return both.groupBy(*keys).agg(F.count("*").alias("pixels"), F.sqrt(F.sum(each) / F.count("*")).alias("rms"))
