"""Single-colour blocks: the endpoints and the code whose colour comes nearest, by lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.channels import bits, replicate

CHANNELS = (("r", 5), ("g", 6), ("b", 5))


def candidates(colours: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key, steps (3, 4) and side (0, 1): endpoints of each channel and the sum of squared errors.

    The table is 2048 rows by its rule, so each channel's lookup is a broadcast join.
    """
    out = colours.select(*keys, "r", "g", "b")
    for c, width in CHANNELS:
        part = table.where(F.col("bits") == width).select("steps", "side", F.col("value").alias(c), F.col("first").alias(f"{c}_first"), F.col("last").alias(f"{c}_last"), F.col("err").alias(f"{c}_err"))
        out = out.join(F.broadcast(part), ["steps", "side", c] if c != "r" else [c])
    error = sum(F.col(f"{c}_err") * F.col(f"{c}_err") for c, _ in CHANNELS)
    return out.select(*keys, "steps", "side", *[f"{c}_{end}" for c, _ in CHANNELS for end in ("first", "last")], error.alias("error"))


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates the one of least error; four steps before three, the endpoint itself before the level beside it."""
    rest = [c for c in found.columns if c not in (*keys, "error", "steps", "side")]
    picked = found.groupBy(*keys).agg(F.min(F.struct("error", (-F.col("steps")).alias("minus"), "side", *rest)).alias("x"))
    return picked.select(*keys, (-F.col("x.minus")).alias("steps"), "x.side", *[F.col(f"x.{c}") for c in rest], "x.error", (F.col("x.side") * 2).alias("code"))


def packed_entry(first: Column, last: Column, err: Column) -> Column:
    """A table's entry in one number: start in 8 bits, end in 8, squared error in 16."""
    return F.shiftleft(first, 24).bitwiseOR(F.shiftleft(last, 16)).bitwiseOR(err * err)


#: The order in which equal errors are taken: (steps, side).
WAYS = ((4, 0), (4, 1), (3, 0), (3, 1))


def best_packed(colours: DataFrame, table: DataFrame) -> DataFrame:
    """The colours with steps, side, ends, error and code of the best of the four ways, read from packed entries.

    The table becomes 256 rows of four entries for each width, a broadcast for each channel; errors are added within the
    row, so nothing is shuffled and rows need no key. The same as best() of candidates(). A colour with a null channel has nulls.
    """
    own = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("minus"), "side", packed_entry(F.col("first"), F.col("last"), F.col("err")).alias("entry"))))
    packed = table.groupBy("bits", "value").agg(F.transform(own, lambda x: x["entry"]).alias("entries"))
    out = colours
    for c, width in CHANNELS:
        part = packed.where(F.col("bits") == width).select(F.col("value").alias("_value"), F.col("entries").alias(f"_{c}"))
        out = out.join(F.broadcast(part), F.col(c) == F.col("_value"), "left").drop("_value")
    errors = [sum(bits(F.col(f"_{c}")[k], 0, 16) for c, _ in CHANNELS) for k in range(len(WAYS))]
    out = out.withColumn("_pick", F.least(*[e * len(WAYS) + k for k, e in enumerate(errors)]))
    out = out.withColumn("_way", F.pmod("_pick", F.lit(len(WAYS))).cast("int"))
    ends = [bits(F.col(f"_{c}")[F.col("_way")], low, 8).alias(f"{c}_{end}") for c, _ in CHANNELS for end, low in (("first", 24), ("last", 16))]
    steps, side = (F.when(F.col("_pick").isNotNull(), F.array(*[F.lit(w[k]).cast("long") for w in WAYS])[F.coalesce("_way", F.lit(0))]) for k in (0, 1))
    return out.select(*colours.columns, steps.alias("steps"), side.alias("side"), *ends, F.floor(F.col("_pick") / len(WAYS)).alias("error"), (side * 2).alias("code"))


def units(found: DataFrame) -> DataFrame:
    """Endpoints as numbers from 0 to 1."""
    return found.select("*", *[(F.col(f"{c}_{end}") / float((1 << width) - 1)).alias(f"{c}_{end}_unit") for c, width in CHANNELS for end in ("first", "last")])


def block_bytes(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c): eight bytes of BC1 for the best candidates. Four steps need the greater colour first, three the other
    way; where the ends stand otherwise they change places, and so does the code."""
    word = lambda e: F.shiftleft(f"r_{e}", 11) + F.shiftleft(f"g_{e}", 5) + F.col(f"b_{e}")
    own = found.select(*keys, "steps", "side", word("first").alias("p"), word("last").alias("q"))
    own = own.withColumn("flip", F.when(F.col("steps") == 4, F.col("p") < F.col("q")).otherwise(F.col("p") > F.col("q")))
    code = F.when(~F.col("flip"), F.col("side") * 2).when(F.col("side") == 0, 1).when(F.col("steps") == 4, 3).otherwise(2)
    own = own.select(*keys, F.when(F.col("flip"), F.col("q")).otherwise(F.col("p")).alias("c0"), F.when(F.col("flip"), F.col("p")).otherwise(F.col("q")).alias("c1"), (code * 85).cast("long").alias("codes"))
    return own.select(*keys, F.array(*[bits(F.col(c), low, 8) for c in ("c0", "c1") for low in (0, 8)], *["codes"] * 4).alias("c"))


def decoded(found: DataFrame) -> DataFrame:
    """Adds the colour that the chosen endpoints and code give back."""
    out = found
    for c, width in CHANNELS:
        s, e = replicate(F.col(f"{c}_first"), width), replicate(F.col(f"{c}_last"), width)
        beside = F.when(F.col("steps") == 4, F.floor((2 * s + e) / 3)).otherwise(F.floor((s + e) / 2))
        out = out.withColumn(f"{c}_back", F.when(F.col("side") == 0, s).otherwise(beside))
    return out
