"""Lookup tables made from their rules: for each value, the endpoints that come nearest to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.sources.generators import grid


def closest(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each value 0 to 255 and key, the candidate (first, last, made) whose made is nearest; ties by first, then last.

    Candidates are first cut to the first pair for each made value, at most 256 for a key, before they meet the values.
    """
    best = candidates.groupBy(*keys, "made").agg(F.min(F.struct("first", "last")).alias("pair"))
    values = candidates.sparkSession.range(256).withColumnRenamed("id", "value")
    met = best.crossJoin(F.broadcast(values)).withColumn("err", F.abs(F.col("value") - F.col("made")))
    picked = met.groupBy(*keys, "value").agg(F.min(F.struct("err", "pair")).alias("x"))
    return picked.select(*keys, "value", F.col("x.pair.first").alias("first"), F.col("x.pair.last").alias("last"), F.col("x.err").alias("err"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def colour_table(spark: SparkSession) -> DataFrame:
    """(bits, steps, side, value, first, last, err): 5- and 6-bit endpoints, 3 or 4 colours; side 0 is an endpoint itself, side 1 the level next to it."""
    parts = []
    for w in (5, 6):
        pairs = grid(spark, first=range(1 << w), last=range(1 << w))
        s, e = ch.replicate(F.col("first"), w), ch.replicate(F.col("last"), w)
        for steps, made in ((3, F.floor((s + e) / 2)), (4, F.floor((2 * s + e) / 3))):
            key = [F.lit(w).cast("long").alias("bits"), F.lit(steps).cast("long").alias("steps")]
            parts.append(pairs.where("first = last").select(*key, F.lit(0).cast("long").alias("side"), "first", "last", s.alias("made")))
            parts.append(pairs.select(*key, F.lit(1).cast("long").alias("side"), "first", "last", made.alias("made")))
    return closest(union(parts), ["bits", "steps", "side"])


def palette_table(spark: SparkSession, bits: int, index_bits: int, case: tuple[int, int] | None = None) -> DataFrame:
    """(idx, value, first, last, err) for the lower half of the indices; case: the lowest bits of both endpoints, if they have one more."""
    pairs = grid(spark, first=range(1 << bits), last=range(1 << bits))
    wide = bits + (case is not None)

    def full(c: str, low: int | None) -> Column:
        return ch.replicate(F.col(c) if low is None else F.col(c) * 2 + low, wide)

    s, e = full("first", case and case[0]), full("last", case and case[1])
    levels = F.explode(F.arrays_zip(*[F.array(*[F.lit(x).cast("long") for x in some]).alias(n) for n, some in (("idx", range(1 << (index_bits - 1))), ("w", ch.WEIGHTS[index_bits]))]))
    each = pairs.select("first", "last", s.alias("s"), e.alias("e"), levels.alias("x")).where("x.idx is not null")
    return closest(each.select(F.col("x.idx").alias("idx"), "first", "last", ch.weighted(F.col("s"), F.col("e"), F.col("x.w")).alias("made")), ["idx"])


def fit_sums(spark: SparkSession, n_max: int = 16) -> DataFrame:
    """(n, i, j, aa, bb, ab, factor): least-squares sums for i points at weight 1, j - i at a half, the rest at 0; factor null if singular."""
    each = grid(spark, n=range(1, n_max + 1), i=range(0, n_max), j=range(0, n_max + 1)).where("i < n and j >= i and j <= n and not (i = 0 and j = 0)")
    aa, bb, ab = F.col("i") + (F.col("j") - F.col("i")) / 4, F.col("n") - F.col("j") + (F.col("j") - F.col("i")) / 4, (F.col("j") - F.col("i")) / 4
    return each.select("n", "i", "j", aa.alias("aa"), bb.alias("bb"), ab.alias("ab"), inverse(aa, bb, ab).alias("factor"))


def fit_sums_four(spark: SparkSession, n: int = 16) -> DataFrame:
    """(i, j, k, aa9, bb9, ab9, factor) for splits of n points at weights 1, 2/3, 1/3 and 0; the sums in ninths."""
    each = grid(spark, i=range(0, n), j=range(0, n + 1), k=range(0, n + 1)).where(f"i <= j and j <= k and k <= {n} and k > 0")
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    aa, bb, ab = 9 * i + 4 * (j - i) + (k - j), 9 * (n - k) + (j - i) + 4 * (k - j), 2 * (j - i) + 2 * (k - j)
    return each.select("i", "j", "k", aa.alias("aa9"), bb.alias("bb9"), ab.alias("ab9"), inverse(aa / 9, bb / 9, ab / 9).alias("factor"))


def inverse(aa: Column, bb: Column, ab: Column) -> Column:
    determinant = aa * bb - ab * ab
    return F.when(F.abs(determinant) > 1e-9, 1 / determinant)


#: How codes change when endpoints are swapped: fixed values.
SWAPPED = {"five": (1, 0, 5, 4, 3, 2, 6, 7), "seven": (1, 0, 7, 6, 5, 4, 3, 2), "three_colours": (1, 0, 2, 3), "four_colours": (1, 0, 3, 2)}
