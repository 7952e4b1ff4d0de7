"""Counts over codebooks and interpolants, and searches for the best ends of a run of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.sources.generators import grid


def codebooks(spark: SparkSession, k: int, low: int, high: int) -> DataFrame:
    """(s, e, book): the k - 1 levels between s and e, low <= s <= e <= high, as one number of bytes."""
    pairs = grid(spark, s=range(low, high + 1), e=range(low, high + 1)).where("s <= e")
    book = sum((F.shiftleft(ch.between(F.col("s"), F.col("e"), k, f), 8 * (f - 1)) for f in range(2, k)), ch.between(F.col("s"), F.col("e"), k, 1))
    return pairs.withColumn("book", book)


def possible(s: Column, e: Column) -> Column:
    """Of two mirrored codebooks the one nearer to 0 is left out."""
    return 254 - e >= s - 1


def ends_of_books(books: DataFrame) -> DataFrame:
    """(book, pairs, least, most): how many pairs of ends give each codebook."""
    return books.groupBy("book").agg(F.count("*").alias("pairs"), F.min(F.struct("s", "e")).alias("a"), F.max(F.struct("s", "e")).alias("z")).select("book", "pairs", F.col("a.s").alias("least_s"), F.col("a.e").alias("least_e"), F.col("z.s").alias("most_s"), F.col("z.e").alias("most_e"))


def end_sets(books: DataFrame) -> DataFrame:
    """(book, ends): the pairs of ends that give each codebook, as start:end in order."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda p: F.concat_ws(":", p["s"].cast("string"), p["e"].cast("string")))
    return books.groupBy("book").agg(F.array_join(pairs, ",").alias("ends"))


def coverage(spark: SparkSession, kinds: list[tuple[str, int, int, bool, int | None]]) -> DataFrame:
    """(kind, level, hits, rmse): for each level, how many of 256 values some pair of ends makes, and how far the others are off.

    A kind is (name, endpoint bits, levels, weights in 64ths, shared lowest bit). A miss counts its distance to the
    nearest lower hit; where there is none, to the nearest higher one. All kinds are one grid of pairs.
    """
    own = lambda values, t: F.element_at(F.array(*[F.lit(v).cast(t) for v in values]), (F.col("k") + 1).cast("int"))
    weights = [ch.WEIGHTS[n.bit_length() - 1] if w else range(n) for _, _, n, w, _ in kinds]
    names, levels = own([k[0] for k in kinds], "string"), own([k[2] for k in kinds], "long")
    most = 1 << max(k[1] for k in kinds)
    pairs = grid(spark, k=range(len(kinds)), st=range(most), en=range(most)).withColumn("bits", own([k[1] for k in kinds], "long")).where("st < power(2, bits) and en < power(2, bits)")
    shared = own([-1 if k[4] is None else k[4] for k in kinds], "long")
    end = lambda c: F.when(shared < 0, F.col(c)).otherwise(F.col(c) - F.pmod(F.col(c), F.lit(2)) + shared)
    expand = lambda x: F.floor((x * F.pow(F.lit(2.0), F.col("bits")) + x) / F.pow(F.lit(2.0), 2 * F.col("bits") - 8))
    table = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in some]) for some in weights]), (F.col("k") + 1).cast("int"))
    whole = own([64 if k[3] else k[2] - 1 for k in kinds], "long")
    each = pairs.select("k", expand(end("st")).alias("s"), expand(end("en")).alias("e"), F.posexplode(table).alias("level", "weight"))
    hits = each.select("k", "level", F.floor((F.col("s") * F.col("weight") + F.col("e") * (whole - F.col("weight"))) / whole).alias("value")).distinct().withColumn("hit", F.lit(1))
    every = grid(spark, k=range(len(kinds)), level=range(max(k[2] for k in kinds)), value=range(256)).where(F.col("level") < levels).withColumn("level", F.col("level").cast("int"))
    order = Window.partitionBy("k", "level").orderBy("value")
    known = F.when(F.col("hit") == 1, F.col("value"))
    each = every.join(hits, ["k", "level", "value"], "left").select("k", "level", "value", "hit", F.last(known, True).over(order).alias("below"), F.first(known, True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    far = F.when(F.col("hit") == 1, 0).otherwise(F.coalesce(F.col("value") - F.col("below"), F.col("above") - F.col("value"), F.lit(256)))
    return each.groupBy("k", "level").agg(F.count("hit").alias("hits"), F.sqrt(F.sum(far * far) / 256).alias("rmse")).select(names.alias("kind"), F.col("level").cast("long").alias("level"), "hits", "rmse")


def levels_error(values: Column, levels: Column) -> Column:
    """The squared error of values to the nearest of some levels each."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + F.array_min(F.transform(levels, lambda m: (v - m) * (v - m))))


def levels_between(s: Column, e: Column, k: int) -> Column:
    return F.array(*[ch.between(s, e, k, f) for f in range(k + 1)])


def nearest_level_error(blocks: DataFrame, keys: list[str], k: int = 7) -> DataFrame:
    """A block's ends and the squared error of its values to the nearest of the k + 1 levels between them.

    Blocks are rows (keys, values), so nothing is shuffled.
    """
    ends = blocks.select(*keys, "values", F.array_min("values").alias("s"), F.array_max("values").alias("e")).withColumn("levels", levels_between(F.col("s"), F.col("e"), k))
    return ends.select(*keys, "s", "e", levels_error(F.col("values"), F.col("levels")).alias("error"))


def tangent_search(blocks: DataFrame, keys: list[str], k: int = 7, steps: int = 4) -> DataFrame:
    """Ends moved in or out by a halving step while that lowers the error: a fixed number of rounds, so it always ends.

    Each round tries both ends half a step in and out, and keeps the least error; the ends as they are come first among
    equals, then the tries by (start, end). Blocks are rows (keys, values), and the rounds run within the row.
    """
    way = lambda moved, s, e: F.struct(F.lit(moved).alias("moved"), s.cast("long").alias("s"), e.cast("long").alias("e"), levels_between(s, e, k).alias("levels"))
    scored = lambda w: F.struct(levels_error(F.col("values"), w["levels"]).alias("error"), w["moved"].alias("moved"), w["s"].alias("s"), w["e"].alias("e"))

    def round_(best: Column, r: Column) -> Column:
        s, e = best["s"], best["e"]
        step = F.floor((e - s) / F.pow(F.lit(2.0), r + 2))
        tries = F.array(*[way(1, F.greatest(s + i * step, ch.number(0)), F.least(e + j * step, ch.number(255))) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1))])
        fair = F.transform(F.filter(tries, lambda t: t["s"] <= t["e"]), scored)
        stay = F.struct(best["error"].alias("error"), F.lit(0).alias("moved"), s.alias("s"), e.alias("e"))
        return F.array_min(F.concat(F.array(stay), fair))

    ends = blocks.select(*keys, "values", way(0, F.array_min("values"), F.array_max("values")).alias("first"))
    out = ends.select(*keys, "values", scored(F.col("first")).alias("first"))
    out = out.select(*keys, F.aggregate(F.array(*[F.lit(r) for r in range(1, steps + 1)]), F.col("first"), round_).alias("best"))
    return out.select(*keys, F.col("best.s").alias("s"), F.col("best.e").alias("e"), F.col("best.error").alias("error"))


def split_sums(texels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For every split of a block's values, ordered by value and texel, in a lower and an upper part: counts and sums of both."""
    order = Window.partitionBy(*keys).orderBy(value, "texel")
    upto, all_of = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    each = texels.select(*keys, F.row_number().over(order).cast("long").alias("low_n"), F.sum(value).over(upto).alias("low_sum"), F.count("*").over(all_of).alias("n"), F.sum(value).over(all_of).alias("sum"))
    return each.select(*keys, "low_n", "low_sum", (F.col("n") - F.col("low_n")).alias("high_n"), (F.col("sum") - F.col("low_sum")).alias("high_sum"))


def best_split(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The split that leaves the least squared error when both parts get their mean; the smaller lower part among equals."""
    gain = F.col("low_sum") * F.col("low_sum") / F.col("low_n") + F.when(F.col("high_n") > 0, F.col("high_sum") * F.col("high_sum") / F.col("high_n")).otherwise(0.0)
    return sums.groupBy(*keys).agg(F.min(F.struct((-gain).alias("minus"), "low_n", "low_sum", "high_n", "high_sum")).alias("x")).select(*keys, "x.low_n", "x.low_sum", "x.high_n", "x.high_sum")


def best_parts(blocks: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, cuts, gain): the split of a block's ordered values in so many runs, some of which may be empty, whose means
    leave the least squared error; gain is the sum over runs of their squared sum over their size. Earlier cuts among equals.

    Blocks are rows (keys, values); running sums and splits are made within the row.
    """
    ordered = blocks.select(*keys, F.array_sort("values").alias("v"))
    sums = F.aggregate("v", F.array(ch.number(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    each = ordered.select(*keys, sums.alias("upto"), F.size("v").alias("n")).withColumn("c0", F.lit(0))
    for k in range(1, parts):
        each = each.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"c{k - 1}"), F.col("n"))))
    at = [*[F.col(f"c{k}") for k in range(parts)], F.col("n")]
    run = lambda a, b: F.when(b > a, F.pow((F.element_at("upto", b + 1) - F.element_at("upto", a + 1)).cast("double"), F.lit(2.0)) / (b - a)).otherwise(0.0)
    gain = sum((run(a, b) for a, b in zip(at[1:], at[2:])), run(at[0], at[1]))
    cuts = [F.col(f"c{k}").cast("long").alias(f"c{k}") for k in range(1, parts)]
    best = each.groupBy(*keys).agg(F.min(F.struct((-gain).alias("minus"), *cuts)).alias("x"))
    return best.select(*keys, *[F.col(f"x.c{k}") for k in range(1, parts)], (-F.col("x.minus")).alias("gain"))
