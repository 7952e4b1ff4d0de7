"""Half-precision numbers of 16 bits, unsigned (5 exponent, 11 mantissa bits) and signed (1, 5, 10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .channels import bits

INFINITY, NAN = float("inf"), float("nan")


def decode(h: Column, signed: bool) -> Column:
    m = 10 if signed else 11
    e, f = bits(h, m, 5), bits(h, 0, m)
    size = F.when(e == 0, f * 2.0 ** (-14 - m)).when((e == 31) & (f == 0), INFINITY).when(e == 31, NAN).otherwise((1 + f * 2.0**-m) * F.pow(F.lit(2.0), e - 15))
    return F.when(bits(h, 15, 1) == 1, -size).otherwise(size) if signed else size


def encode(x: Column, signed: bool) -> Column:
    """Truncates towards zero; 65536 and more is infinity; without a sign, negative numbers are 0."""
    m = 10 if signed else 11
    size = F.abs(x) if signed else F.when(x < 0, 0.0).otherwise(x)
    e = F.when(size < 2.0**-14, 0).otherwise(F.floor(F.log2(F.greatest(size, F.lit(2.0**-14)))) + 15)
    f = F.when(e == 0, F.floor(size * 2.0 ** (14 + m))).otherwise(F.floor((size / F.pow(F.lit(2.0), e - 15) - 1) * 2.0**m))
    low = F.when(size >= 65536.0, 31 << m).otherwise(e * (1 << m) + f).cast("long")
    return low + F.when(x < 0, 1 << 15).otherwise(0) if signed else low
