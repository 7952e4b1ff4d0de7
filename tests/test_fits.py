"""Fits by lookup and nearest hits against plain versions."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import lookups, nearest, palette_fit, single_colour
from blockloom.plans.tables import PALETTES


@pytest.mark.parametrize("name", ["palette_5_4", "palette_8_4", "palette_4u1_8", "palette_6s1_8"])
def test_tables_are_those_of_the_rule(spark, name):
    bits, index_bits, cases = PALETTES[name]
    far, ends = palette_fit.table(*PALETTES[name])
    for k, case in enumerate(cases):
        for r in lookups.palette_table(spark, bits, index_bits, case).collect():
            at = k * (1 << index_bits - 1) + r.idx
            assert (far[r.value, at], *divmod(ends[r.value, at], 256)) == (r.err, r.first, r.last)


def test_pixels_keep_keys_and_their_error(spark):
    draw = random.Random(3)
    rows = [(f"k{i}", *(draw.randrange(256) for _ in range(4))) for i in range(300)] + [("grey", 7, 7, 7, 7)] * 2 + [("none", None, 1, 2, 3)]
    pixels = spark.createDataFrame(rows, "name string, r long, g long, b long, a long")
    some = {n: PALETTES[n] for n in ("palette_5u1_4", "palette_7_8")}
    found = palette_fit.fit_pixels(pixels, ["name"], some).collect()
    assert len(found) == 302 * 2
    own = {r[0]: r[1:] for r in rows}
    for r in found:
        bits, index_bits, cases = PALETTES[r.palette]
        case, w = cases[r.case], palette_fit.WEIGHTS[index_bits][r.idx]
        wide = bits + (case is not None)
        full = lambda x, low: (x << 8 - wide) | (x >> 2 * wide - 8) if case is None else ((2 * x + low) << 8 - wide) | ((2 * x + low) >> 2 * wide - 8)
        made = [(full(r[f"{c}_first"], case and case[0]) * (64 - w) + full(r[f"{c}_last"], case and case[1]) * w) >> 6 for c in "rgba"]
        assert sum((m - v) ** 2 for m, v in zip(made, own[r.name])) == r.error
    far, _ = palette_fit.table(*some["palette_5u1_4"])
    assert all(r.error == min((far[np.array(own[r.name])] ** 2).sum(0)) for r in found if r.palette == "palette_5u1_4")
    assert palette_fit.fit_pixels(pixels.limit(0), ["name"], some).isEmpty()


def test_packed_entries_give_the_same_fit(spark):
    draw = random.Random(5)
    rows = [(i, *(draw.randrange(256) for _ in range(3))) for i in range(400)] + [(400, 0, 0, 0), (401, 255, 255, 255), (402, 128, 128, 128)]
    colours, table = spark.createDataFrame(rows, "id long, r long, g long, b long"), lookups.colour_table(spark)
    plain = single_colour.best(single_colour.candidates(colours, table, ["id"]), ["id"])
    found = single_colour.best_packed(colours, table)
    assert found.select(plain.columns).exceptAll(plain).isEmpty() and found.count() == len(rows)
    none = single_colour.best_packed(spark.createDataFrame([(1, None, 3, 4)], "id long, r long, g long, b long"), table).first()
    assert none.steps is None and none.error is None and none.code is None


def plain_nearest(rows, hits):
    by = {}
    for k, v in hits:
        if k is not None and v is not None and not math.isnan(v):
            by.setdefault(k, set()).add(v)
    by = {k: sorted(v) for k, v in by.items()}
    out = []
    for i, k, v in rows:
        own = by.get(k, []) if v is not None and not math.isnan(v) else []
        lo, hi = (bisect.bisect_right(own, v), bisect.bisect_left(own, v)) if own else (0, 0)
        out.append((i, own[lo - 1] if lo else None, own[hi] if hi < len(own) else None))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_nearest_hits_of_skewed_keys(spark, n):
    draw = random.Random(n)
    rows = [(i, draw.choice(["hot"] * 8 + ["a", "b", "no hits", None]), draw.choice([5.0, draw.randrange(400) / 4, None, float("nan"), -0.0])) for i in range(3000)]
    # long stretches without hits, so that ranges are crossed; ends without any
    hits = [("hot", v) for v in (3.0, 5.0, 5.0, 80.25, 81.0)] + [("a", 50.0), ("b", 0.0), (None, 1.0), ("b", None), ("a", float("nan")), ("other", 7.0)]
    given = spark.createDataFrame(rows, "id long, k string, v double").withColumn("bin", F.lit("own"))
    found = nearest.nearest_hits(given, spark.createDataFrame(hits, "k string, v double"), "k", "v", n)
    assert found.columns == ["id", "k", "v", "bin", "below", "above"]
    assert sorted((r.id, r.below, r.above) for r in found.collect()) == plain_nearest(rows, hits)


def test_nearest_hits_of_nothing(spark):
    given = spark.createDataFrame([(1, "a", 2.0)], "id long, k string, v double")
    assert nearest.nearest_hits(given.limit(0), given, "k", "v").isEmpty()
    assert nearest.nearest_hits(given, given.limit(0), "k", "v").select("below", "above").first() == (None, None)
    infinite = spark.createDataFrame([(1, "a", float("inf")), (2, "a", float("-inf"))], "id long, k string, v double")
    assert {tuple(r) for r in nearest.nearest_hits(infinite, given, "k", "v").select("id", "below", "above").collect()} == {(1, 2.0, None), (2, None, 2.0)}
