"""Encoders of our own: a BC1 range fit on the box of a block's colours, and the packing of FXT1's mixed halves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.channels import bits, number, replicate

WIDTHS = (("r", 5), ("g", 6), ("b", 5))


def channel(e: Column, k: int) -> Column:
    """The 16 values of one channel of a block of 64 RGBA values."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.element_at(e, t * 4 + k + 1))


#: Weights of red, green and blue in a texel's error, in ten-thousandths: alike, or as the eye sees them (fixed values).
METRICS = {"uniform": (1, 1, 1), "perceptual": (2126, 7152, 722)}


def range_fit(blocks: DataFrame, keys: list[str], metric: str = "uniform") -> DataFrame:
    """(keys, c): eight bytes of BC1 for blocks (keys, e) of 64 RGBA values.

    Ends are the greatest and the least value of each channel, cut to 5, 6 and 5 bits; every texel takes the code of
    least squared error by the metric, the lowest among equals. A block of one colour after cutting has code 0 throughout. One row is
    one block, so nothing is shuffled.
    """
    ends = blocks.select(*keys, "e", *[f(channel(F.col("e"), k)).alias(f"{n}_{c}") for k, (c, _) in enumerate(WIDTHS) for n, f in (("high", F.array_max), ("low", F.array_min))])
    ends = ends.select(*keys, "e", *[F.shiftright(f"{n}_{c}", 8 - w).alias(f"{n}_{c}") for c, w in WIDTHS for n in ("high", "low")])
    first, last = ([replicate(F.col(f"{n}_{c}"), w) for c, w in WIDTHS] for n in ("high", "low"))
    palette = [F.array(*some) for some in (first, last, [F.floor((2 * a + b) / 3) for a, b in zip(first, last)], [F.floor((a + 2 * b) / 3) for a, b in zip(first, last)])]
    word = lambda n: F.shiftleft(F.col(f"{n}_r"), 11) + F.shiftleft(F.col(f"{n}_g"), 5) + F.col(f"{n}_b")
    own = ends.select(*keys, "e", word("high").alias("c0"), word("low").alias("c1"), F.array(*palette).alias("p"))

    def code(t: Column) -> Column:
        error = lambda p: sum(w * (F.element_at("e", t * 4 + k + 1) - p[k]) * (F.element_at("e", t * 4 + k + 1) - p[k]) for k, w in enumerate(METRICS[metric]))
        best = F.array_min(F.transform("p", lambda p, i: F.struct(error(p).alias("error"), i.alias("code"))))
        return F.when(F.col("c0") == F.col("c1"), 0).otherwise(best["code"]).cast("long")

    own = own.select(*keys, "c0", "c1", F.transform(F.sequence(F.lit(0), F.lit(15)), code).alias("codes"))
    codes = [sum((F.element_at("codes", 4 * k + i + 1) * 4**i for i in range(1, 4)), F.element_at("codes", 4 * k + 1)) for k in range(4)]
    ends_bytes = [bits(F.col(c), low, 8) for c in ("c0", "c1") for low in (0, 8)]
    return own.select(*keys, F.array(*ends_bytes, *codes).alias("c"))


def explicit_alpha(e: Column) -> Column:
    """Eight bytes: the nearest of 16 alphas for each texel, the first in the low half of a byte."""
    four = F.transform(channel(e, 3), lambda a: F.floor((a + 8) / 17))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.element_at(four, 2 * k + 1) + 16 * F.element_at(four, 2 * k + 2))


def ramp_alpha(blocks: DataFrame) -> DataFrame:
    """Adds alpha, eight bytes: the greatest and the least alpha, and for each texel the nearest of eight levels, the
    lowest code among equals; code 0 throughout where all are equal."""
    own = blocks.withColumn("_v", channel(F.col("e"), 3)).withColumns({"_a0": F.array_max("_v"), "_a1": F.array_min("_v")})
    levels = F.array(F.col("_a0"), F.col("_a1"), *[F.floor(((7 - k) * F.col("_a0") + k * F.col("_a1")) / 7) for k in range(1, 7)])
    nearest = lambda x: F.array_min(F.transform("_levels", lambda m, i: F.struct(F.abs(x - m).alias("far"), i.cast("long").alias("code"))))["code"]
    own = own.withColumn("_levels", levels).withColumn("_codes", F.transform("_v", lambda x: F.when(F.col("_a0") == F.col("_a1"), number(0)).otherwise(nearest(x))))
    half = lambda k: sum((F.element_at("_codes", 8 * k + i + 1) * 8**i for i in range(1, 8)), F.element_at("_codes", 8 * k + 1))
    own = own.withColumns({"_low": half(0), "_high": half(1)})
    return own.select(*blocks.columns, F.array("_a0", "_a1", *[bits(F.col(h), 8 * k, 8) for h in ("_low", "_high") for k in range(3)]).alias("alpha"))


CODECS = {"bc1": 8, "bc2": 16, "bc3": 16}


def compressed(blocks: DataFrame, keys: list[str], codec: str = "bc1", metric: str = "uniform", colours: Callable[[DataFrame, list[str], str], DataFrame] = range_fit) -> DataFrame:
    """(keys, c): the bytes of blocks (keys, e) of 64 RGBA values; bc2 and bc3 have eight bytes of alpha before the colours."""
    if codec == "bc1":
        return colours(blocks, keys, metric).select(*keys, "c")
    own = blocks.withColumn("alpha", explicit_alpha(F.col("e"))) if codec == "bc2" else ramp_alpha(blocks)
    return colours(own, [*keys, "alpha"], metric).select(*keys, F.concat("alpha", "c").alias("c"))


def mixed_half(halves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, colours, bit): 32 bits of codes, 30 bits of two colours and green's lowest bit, from (keys, a, b, codes).

    a and b are RGB565 words, codes 16 numbers of two bits. The first code's upper bit must tell the lowest bits of
    green apart; where it does not, the colours change places and all codes are inverted.
    """
    differ = F.pmod(F.shiftright("a", 5) + F.shiftright("b", 5), F.lit(2))
    swap = F.shiftright(F.element_at("codes", 1), 1) != differ
    own = halves.select(*keys, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("second"), F.when(swap, F.transform("codes", lambda c: 3 - c)).otherwise(F.col("codes")).alias("codes"))
    narrow = lambda c: F.shiftleft(bits(F.col(c), 11, 5), 10) + F.shiftleft(bits(F.col(c), 6, 5), 5) + bits(F.col(c), 0, 5)
    low = sum((F.shiftleft(F.element_at("codes", i + 1), 2 * i) for i in range(1, 16)), F.element_at("codes", 1))
    return own.select(*keys, low.alias("low"), (F.shiftleft(narrow("second"), 15) + narrow("first")).alias("colours"), bits(F.col("second"), 5, 1).alias("bit"))


def opaque(blocks: DataFrame) -> DataFrame:
    """Blocks (…, e) of three channels a texel as RGBA with alpha 255."""
    return blocks.withColumn("e", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.concat(F.slice("e", t * 3 + 1, 3), F.array(number(255))))))
