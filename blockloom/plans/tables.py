"""Queries on lookup tables and single-colour blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.operators import lookups, single_colour
from blockloom.sources import fixtures
from blockloom.sources.generators import one_colour


def sql_replicate(v: str, w: int) -> str:
    return v if w == 8 else f"((({v}) << {8 - w}) | (({v}) >> {2 * w - 8}))"


def _colour_part(w: int, steps: int) -> str:
    s, e = sql_replicate("s", w), sql_replicate("e", w)
    made = f"({s} + {e}) // 2" if steps == 3 else f"(2 * {s} + {e}) // 3"
    pairs = f"range({1 << w}) a(s), range({1 << w}) b(e)"
    return f"SELECT {w} AS bits, {steps} AS steps, 0 AS side, s, e, {s} AS made FROM {pairs} WHERE s = e UNION ALL SELECT {w}, {steps}, 1, s, e, {made} FROM {pairs}"


COLOUR_CTE = f"""
can AS ({" UNION ALL ".join(_colour_part(w, n) for w in (5, 6) for n in (3, 4))}),
uni AS (SELECT DISTINCT ON (bits, steps, side, made) * FROM can ORDER BY bits, steps, side, made, s, e),
lut AS (SELECT DISTINCT ON (bits, steps, side, value) bits, steps, side, value, s AS first, e AS last, abs(value - made) AS err FROM uni, range(256) v(value) ORDER BY bits, steps, side, value, abs(value - made), s, e)
"""
CAST_LUT = "CAST(bits AS BIGINT) AS bits, CAST(steps AS BIGINT) AS steps, CAST(side AS BIGINT) AS side, value, first, last, err"

#: (name, endpoint bits, index bits, cases of lowest bits)
PALETTES = {
    "palette_5_4": (5, 2, [None]), "palette_6_4": (6, 2, [None]), "palette_7_4": (7, 2, [None]), "palette_8_4": (8, 2, [None]), "palette_5_8": (5, 3, [None]), "palette_6_8": (6, 3, [None]), "palette_7_8": (7, 3, [None]), "palette_8_16": (8, 4, [None]),
    "palette_5u1_4": (5, 2, [(0, 0), (1, 0), (0, 1), (1, 1)]), "palette_7u1_4": (7, 2, [(0, 0), (1, 0), (0, 1), (1, 1)]), "palette_4u1_8": (4, 3, [(0, 0), (1, 0), (0, 1), (1, 1)]), "palette_7u1_16": (7, 4, [(0, 0), (1, 0), (0, 1), (1, 1)]), "palette_6s1_8": (6, 3, [(0, 0), (1, 1)]),
}


def palette(name: str):
    bits, index_bits, cases = PALETTES[name]

    def run(spark, d):
        parts = [lookups.palette_table(spark, bits, index_bits, c).withColumn("case", F.lit(k).cast("long")) for k, c in enumerate(cases)]
        return lookups.union(parts).select("case", "idx", "value", "first", "last", "err")

    return run


def palette_sql(name: str) -> str:
    bits, index_bits, cases = PALETTES[name]
    w = bits + (cases[0] is not None)
    ends = [(sql_replicate(f"(s * 2 + {c[0]})" if c else "s", w), sql_replicate(f"(e * 2 + {c[1]})" if c else "e", w)) for c in cases]
    levels = ", ".join(f"({i}, {x})" for i, x in enumerate(ch.WEIGHTS[index_bits][: 1 << (index_bits - 1)]))
    can = " UNION ALL ".join(f"SELECT {k} AS c, idx, s, e, ({s} * (64 - w) + {e} * w) >> 6 AS made FROM range({1 << bits}) a(s), range({1 << bits}) b(e), lev" for k, (s, e) in enumerate(ends))
    return f"""WITH lev(idx, w) AS (VALUES {levels}), can AS ({can}),
    uni AS (SELECT c, idx, made, min(s * 65536 + e) AS pair FROM can GROUP BY c, idx, made),
    r AS (SELECT c, idx, value, pair, abs(value - made) AS err, row_number() OVER (PARTITION BY c, idx, value ORDER BY abs(value - made), pair) AS o FROM uni, range(256) v(value))
    SELECT CAST(c AS BIGINT) AS "case", CAST(idx AS BIGINT) AS idx, value, pair // 65536 AS first, pair % 65536 AS last, err FROM r WHERE o = 1"""


def compact(spark, d):
    """The compact tables: what the level beside the endpoint, or the palette's second index, takes."""
    colour = lookups.colour_table(spark).where("side = 1").select(F.format_string("colour_%d_%d", "bits", "steps").alias("name"), "value", "first", "last")
    parts = [lookups.palette_table(spark, bits, index_bits, cases[0]).where("idx = 1").select(F.lit(n).alias("name"), "value", "first", "last") for n, (bits, index_bits, cases) in PALETTES.items() if len(cases) == 1]
    return lookups.union([colour, *parts])


def compact_sql() -> str:
    plain = [n for n, (_, _, cases) in PALETTES.items() if len(cases) == 1]
    parts = [f"SELECT '{n}' AS name, value, first, last FROM ({palette_sql(n)}) WHERE idx = 1" for n in plain]
    return f"WITH {COLOUR_CTE} SELECT 'colour_' || bits || '_' || steps AS name, value, first, last FROM lut WHERE side = 1 UNION ALL " + " UNION ALL ".join(parts)


def deltas(spark, d):
    """What moving one point from weight 0 up to the next weight adds to the least-squares sums (aa, bb, ab)."""
    steps = spark.sql("SELECT * FROM VALUES ('three_colours', 2L), ('four_colours', 3L) AS t(kind, parts)")
    w = F.lit(1.0) / F.col("parts")
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(16).cast("long")))
    return steps.select("kind", n.alias("n"), (w * w).alias("aa"), ((1 - w) * (1 - w) - 1).alias("bb"), (w * (1 - w)).alias("ab"))


def worst_errors(spark, d):
    """Greatest error of each colour table: the bound that single-colour blocks keep."""
    return lookups.colour_table(spark).groupBy("bits", "steps").agg(F.min("err").alias("least"), F.max("err").alias("most")).select("bits", "steps", "least", "most")


def packed(spark, d):
    """Each entry in one number: start in 8 bits, end in 8, squared error in 16, and read back."""
    t = lookups.colour_table(spark)
    t = t.withColumn("packed", single_colour.packed_entry(F.col("first"), F.col("last"), F.col("err")))
    return t.select("bits", "steps", "side", "value", "packed", ch.bits(F.col("packed"), 24, 8).alias("first"), ch.bits(F.col("packed"), 16, 8).alias("last"), ch.bits(F.col("packed"), 0, 16).alias("err_sq"))


def swapped(spark, d):
    return spark.createDataFrame([(n, k, v) for n, some in lookups.SWAPPED.items() for k, v in enumerate(some)], "kind string, code long, swapped long")


SWAPPED_SQL = """
WITH a AS (SELECT kind, code, CASE WHEN code < 2 THEN 1 - code WHEN kind = 'five' AND code < 6 THEN 7 - code WHEN kind = 'seven' THEN 9 - code WHEN kind = 'four_colours' THEN 5 - code ELSE code END AS swapped
FROM (VALUES ('five', 8), ('seven', 8), ('three_colours', 4), ('four_colours', 4)) v(kind, n), range(8) s(code) WHERE code < n) SELECT * FROM a
"""


def first_texels(spark, d):
    return fixtures.texels(spark, d).where("texel = 0").select("vec_id", "r", "g", "b", "a")


def fit_sides(spark, d):
    """All four ways for each block's first texel."""
    return single_colour.candidates(first_texels(spark, d), lookups.colour_table(spark), ["vec_id"])


def fit_four(spark, d):
    """Four steps only: both sides, the better of them."""
    return single_colour.best(fit_sides(spark, d).where("steps = 4"), ["vec_id"])


def fit_best(spark, d):
    return single_colour.units(single_colour.best(fit_sides(spark, d), ["vec_id"]))


def fit_by_alpha(spark, d):
    """Opaque blocks take four steps, blocks with a transparent texel three, where transparency is asked for (odd ids here)."""
    seen = fixtures.texels(spark, d).groupBy("vec_id").agg((F.min("a") < 128).alias("clear"))
    wanted = F.when(F.pmod("vec_id", F.lit(2)) == 0, 4).when(F.col("clear"), 3)
    found = fit_sides(spark, d).join(seen.select("vec_id", "clear", wanted.cast("long").alias("only")), "vec_id").where("only is null or only = steps")
    return single_colour.best(found.drop("clear", "only"), ["vec_id"])


def round_trip(spark, d):
    """Encodes and decodes the one-colour blocks, and sums up as the harness does: least, greatest and mean-square error."""
    found = single_colour.decoded(single_colour.best(single_colour.candidates(one_colour(spark), lookups.colour_table(spark), ["channel", "value"]), ["channel", "value"]))
    back = found.join(one_colour(spark), ["channel", "value"])
    mse = sum((F.col(f"{c}_back") - F.col(c)) * (F.col(f"{c}_back") - F.col(c)) for c in "rgb")
    return back.groupBy("channel").agg(F.count("*").alias("n"), F.sqrt(F.min(mse)).alias("least"), F.sqrt(F.max(mse)).alias("most"), F.sqrt(F.sum(mse) / F.count("*")).alias("rms"), F.bool_and(mse == F.col("error")).alias("as_promised"))


ENDS = [f"{c}_{e}" for c in "rgb" for e in ("first", "last")]


def _sides(source: str, keys: str) -> str:
    joins = " ".join(f"JOIN lut l{c} ON l{c}.bits = {w} AND l{c}.value = p.{c}" + ("" if c == "r" else f" AND l{c}.steps = lr.steps AND l{c}.side = lr.side") for c, w in single_colour.CHANNELS)
    ends = ", ".join(f"l{c}.{e} AS {c}_{e}" for c in "rgb" for e in ("first", "last"))
    return f"way AS (SELECT {keys}, lr.steps, lr.side, {ends}, lr.err * lr.err + lg.err * lg.err + lb.err * lb.err AS error FROM {source} p {joins})"


def _best(keys: str, where: str = "true") -> str:
    return f"pick AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY error, steps DESC, side, {', '.join(ENDS)}) AS o FROM way WHERE {where})"


LONGS = "CAST(steps AS BIGINT) AS steps, CAST(side AS BIGINT) AS side"
FIRST = f"{fixtures.SQL_TEXELS}, one AS (SELECT vec_id, r, g, b FROM tex WHERE texel = 0)"
ONE_COLOUR = "gen AS (SELECT channel, value, CASE WHEN channel = 0 THEN value ELSE 0 END AS r, CASE WHEN channel = 1 THEN value ELSE 0 END AS g, CASE WHEN channel = 2 THEN value ELSE 0 END AS b FROM range(3) s(channel), range(255) t(value))"
_BACK = {c: f"CASE WHEN k.side = 0 THEN {sql_replicate(f'{c}_first', w)} WHEN k.steps = 4 THEN (2 * {sql_replicate(f'{c}_first', w)} + {sql_replicate(f'{c}_last', w)}) // 3 ELSE ({sql_replicate(f'{c}_first', w)} + {sql_replicate(f'{c}_last', w)}) // 2 END" for c, w in single_colour.CHANNELS}

QUERIES = {
    "src7_colour_table": lambda spark, d: lookups.colour_table(spark), "sc28_packed_table": packed, "src7_worst_errors": worst_errors, "agg15_fit_sums": lambda spark, d: lookups.fit_sums(spark), "agg15_fit_sums_four": lambda spark, d: lookups.fit_sums_four(spark), "jn10_swapped_codes": swapped,
    "src7_compact_tables": compact, "agg15_deltas": deltas,
    "jn1_agg14_fit_sides": fit_sides, "fit4_agg9_four_steps": fit_four, "fit5_fit7_agg10_best": fit_best, "fit2_by_alpha": fit_by_alpha, "agg4_round_trip": round_trip, **{f"src7_{n}": palette(n) for n in PALETTES},
}
SQL = {
    "src7_colour_table": f"WITH {COLOUR_CTE} SELECT {CAST_LUT} FROM lut",
    "sc28_packed_table": f"WITH {COLOUR_CTE} SELECT CAST(bits AS BIGINT) AS bits, CAST(steps AS BIGINT) AS steps, CAST(side AS BIGINT) AS side, value, (first << 24) + (last << 16) + err * err AS packed, first, last, err * err AS err_sq FROM lut",
    "src7_worst_errors": f"WITH {COLOUR_CTE} SELECT CAST(bits AS BIGINT) AS bits, CAST(steps AS BIGINT) AS steps, min(err) AS least, max(err) AS most FROM lut GROUP BY bits, steps",
    "agg15_fit_sums": """WITH a AS (SELECT n, i, j, i + (j - i) / 4.0::DOUBLE AS aa, n - j + (j - i) / 4.0::DOUBLE AS bb, (j - i) / 4.0::DOUBLE AS ab FROM range(1, 17) q(n), range(16) s(i), range(17) t(j) WHERE i < n AND j >= i AND j <= n AND NOT (i = 0 AND j = 0))
    SELECT *, CASE WHEN abs(aa * bb - ab * ab) > 1e-9 THEN 1 / (aa * bb - ab * ab) END AS factor FROM a""",
    "agg15_fit_sums_four": """WITH a AS (SELECT i, j, k, 9 * i + 4 * (j - i) + (k - j) AS aa9, 9 * (16 - k) + (j - i) + 4 * (k - j) AS bb9, 2 * (j - i) + 2 * (k - j) AS ab9 FROM range(16) s(i), range(17) t(j), range(17) u(k) WHERE i <= j AND j <= k AND k > 0),
    b AS (SELECT *, (aa9 / 9.0::DOUBLE) * (bb9 / 9.0::DOUBLE) - (ab9 / 9.0::DOUBLE) * (ab9 / 9.0::DOUBLE) AS det FROM a) SELECT i, j, k, aa9, bb9, ab9, CASE WHEN abs(det) > 1e-9 THEN 1 / det END AS factor FROM b""",
    "jn10_swapped_codes": SWAPPED_SQL,
    "src7_compact_tables": compact_sql(),
    "agg15_deltas": "SELECT kind, n, w * w AS aa, (1 - w) * (1 - w) - 1 AS bb, w * (1 - w) AS ab FROM (SELECT kind, 1.0::DOUBLE / parts AS w FROM (VALUES ('three_colours', 2), ('four_colours', 3)) t(kind, parts)), range(1, 17) s(n)",
    "jn1_agg14_fit_sides": f"WITH {COLOUR_CTE}, {FIRST}, {_sides('one', 'p.vec_id')} SELECT vec_id, {LONGS}, {', '.join(ENDS)}, error FROM way",
    "fit4_agg9_four_steps": f"WITH {COLOUR_CTE}, {FIRST}, {_sides('one', 'p.vec_id')}, {_best('vec_id', 'steps = 4')} SELECT vec_id, {LONGS}, {', '.join(ENDS)}, error, CAST(side * 2 AS BIGINT) AS code FROM pick WHERE o = 1",
    "fit5_fit7_agg10_best": f"WITH {COLOUR_CTE}, {FIRST}, {_sides('one', 'p.vec_id')}, {_best('vec_id')} SELECT vec_id, {LONGS}, {', '.join(ENDS)}, error, CAST(side * 2 AS BIGINT) AS code, {', '.join(f'{c}_{e} / {(1 << w) - 1}.0::DOUBLE AS {c}_{e}_unit' for c, w in single_colour.CHANNELS for e in ('first', 'last'))} FROM pick WHERE o = 1",
    "fit2_by_alpha": f"WITH {COLOUR_CTE}, {FIRST}, al AS (SELECT vec_id AS v, CASE WHEN vec_id % 2 = 0 THEN 4 WHEN min(a) < 128 THEN 3 END AS one_way FROM tex GROUP BY vec_id), {_sides('one JOIN al ON al.v = one.vec_id', 'p.vec_id').replace('FROM one JOIN al ON al.v = one.vec_id p', 'FROM one p JOIN al ON al.v = p.vec_id').replace('AS (SELECT p.vec_id', 'AS (SELECT p.vec_id, al.one_way')}, {_best('vec_id', 'one_way IS NULL OR one_way = steps')} SELECT vec_id, {LONGS}, {', '.join(ENDS)}, error, CAST(side * 2 AS BIGINT) AS code FROM pick WHERE o = 1",
    "agg4_round_trip": f"WITH {COLOUR_CTE}, {ONE_COLOUR}, {_sides('gen', 'p.channel, p.value, p.r, p.g, p.b')}, {_best('channel, value')}, bk AS (SELECT channel, error, {' + '.join(f'({x} - k.{c}) * ({x} - k.{c})' for c, x in _BACK.items())} AS mse FROM pick k WHERE o = 1) SELECT channel, count(*) AS n, sqrt(min(mse)) AS least, sqrt(max(mse)) AS most, sqrt(CAST(sum(mse) AS DOUBLE) / count(*)) AS rms, bool_and(mse = error) AS as_promised FROM bk GROUP BY channel",
    **{f"src7_{n}": palette_sql(n) for n in PALETTES},
}
