"""Channel arithmetic as column expressions: bit replication, quantisers, residual coding, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def bits(x: Column, low: int, count: int) -> Column:
    """So many bits of a number from bit low on."""
    return F.shiftright(x, low).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def replicate(v: Column, width: int) -> Column:
    """A value of 4 to 8 bits as 8 bits: its top bits fill up what is missing."""
    return v if width == 8 else F.shiftleft(v, 8 - width).bitwiseOR(F.shiftright(v, 2 * width - 8))


def spread(v: Column, width: int) -> Column:
    """A value of 1 to 8 bits as 8 bits, by repeated halving of the shift."""
    out = F.shiftleft(v, 8 - width)
    for k in (1, 2, 3):
        out = out.bitwiseOR(F.shiftright(out, k * width))
    return out


def multiplier(width: int, total: int = 32) -> int:
    """The number that repeats a value of this width from the top of a word, whole repetitions only."""
    return sum(1 << (total - k * width) for k in range(1, total // width + 1))


def reconstruct(p: Column, position: int, width: int, precision: int) -> Column:
    """A value of so many bits, repeated to the precision and placed with its top at the position."""
    value = F.shiftright((p * multiplier(width)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 32 - position)
    cut = ((0xFFFFFFFF << (32 - precision)) & 0xFFFFFFFF) >> (32 - position)
    return value.bitwiseAND(F.lit(cut).cast("long")) if cut > (1 << precision) - 1 else value


def code(e: Column, position: int, width: int, precision: int) -> tuple[Column, Column]:
    """The greatest value whose reconstruction is at most e, and what is left of e."""
    top = F.shiftright(e, position - width)
    over = reconstruct(top, position, width, precision) > e
    top = F.when(over, top - 1).otherwise(top)
    return top, e - reconstruct(top, position, width, precision)


def truncated(v: Column, width: int) -> Column:
    return spread(F.shiftright(v, 8 - width), width)


def nearest(v: Column, width: int) -> Column:
    """The level of the nearest-rounding quantiser: floor(v/255 * (2^width - 1) + half)."""
    levels = (1 << width) - 1
    return F.floor(v / 255.0 * levels + 0.5 * (1 << (8 - width)) * levels / 255.0)


def linear(v: Column, threshold: float = 0.04045) -> Column:
    """sRGB to linear light, of 0 to 255."""
    c = v / 255.0
    return F.when(c <= threshold, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def between(s: Column, e: Column, k: int, f: Column | int) -> Column:
    """The f-th of k - 1 levels between s and e, rounded down."""
    f = number(f) if isinstance(f, int) else f
    return F.floor(((k - f) * s + f * e) / k)


def endpoint(v: Column, width: int) -> Column:
    return F.shiftright(v * (1 << width) + v, 2 * width - 8)


def weighted(s: Column, e: Column, weight: Column | int) -> Column:
    """Interpolation in 64ths, rounded down."""
    return F.shiftright(s * (64 - weight) + e * weight, 6)


#: Interpolation weights in 64ths for 1 to 4 index bits: fixed values.
WEIGHTS = {1: (0, 64), 2: (0, 21, 43, 64), 3: (0, 9, 18, 27, 37, 46, 55, 64), 4: (0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64)}
