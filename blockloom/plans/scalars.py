"""Queries on channel arithmetic: every function over its whole domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.functions import halves
from blockloom.sources import fixtures
from blockloom.sources.generators import directions, grid


def reconstructor(spark, d):
    each = spark.range(1, 17).withColumnRenamed("id", "width")
    terms = F.transform(F.sequence(F.lit(1), F.floor(F.lit(32) / F.col("width")).cast("int")), lambda k: F.pow(F.lit(2.0), 32 - k * F.col("width")).cast("long"))
    return each.select("width", F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x).alias("multiplier"))


def reconstruct(spark, d):
    parts = [grid(spark, p=range(1 << w)).select(F.lit(w).cast("long").alias("width"), F.lit(pos).cast("long").alias("position"), "p", ch.reconstruct(F.col("p"), pos, w, 8).alias("value")) for w in (4, 5, 6, 7, 8) for pos in (8, 9, 12, 14, 16)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


RECONSTRUCT_SQL = """
WITH m AS (SELECT width, CAST(list_sum(list_transform(range(1, CAST(floor(32 / width) AS BIGINT) + 1), lambda k: CAST(pow(2, 32 - k * width) AS BIGINT))) AS BIGINT) AS multiplier FROM range(4, 9) s(width)),
v AS (SELECT width, position, p, ((p * multiplier) & 4294967295) >> (32 - position) AS val, 4278190080 >> (32 - position) AS cut FROM m, (VALUES (8), (9), (12), (14), (16)) q(position), range(256) t(p) WHERE p < (1 << width))
SELECT width, CAST(position AS BIGINT) AS position, p, CASE WHEN cut > 255 THEN val & cut ELSE val END AS value FROM v
"""


def residual_coder(spark, d):
    """14 bits as 6, 5 and 5 with one bit of overlap: value and rest of each stage."""
    i = F.col("i")
    g, rest_g = ch.code(i, 14, 6, 8)
    out = spark.range(1 << 14).withColumnRenamed("id", "i").select("i", g.alias("g"), rest_g.alias("rest_g"))
    b, rest_b = ch.code(F.col("rest_g"), 9, 5, 8)
    out = out.select("*", b.alias("b"), rest_b.alias("rest_b"))
    r, rest_r = ch.code(F.col("rest_b"), 5, 5, 8)
    return out.select("*", r.alias("r"), rest_r.alias("rest_r"))


def sql_code(e: str, position: int, width: int, top: str) -> str:
    """Text of (top, rest) for the coder; written out for DuckDB."""
    m = ch.multiplier(width)
    cut = 0xFF000000 >> (32 - position)
    rec = lambda t: f"((({t}) * {m}) & 4294967295) >> {32 - position}"
    rec_ = (lambda t: f"(({rec(t)}) & {cut})") if cut > 255 else (lambda t: f"({rec(t)})")
    first = f"({e} >> {position - width})"
    value = f"CASE WHEN {rec_(first)} > {e} THEN {first} - 1 ELSE {first} END"
    return f"{value} AS {top}, {e} - {rec_(value)} AS rest_{top}"


CODER_SQL = f"""
a AS (SELECT i, {sql_code("i", 14, 6, "g")} FROM range(16384) s(i)),
b AS (SELECT *, {sql_code("rest_g", 9, 5, "b")} FROM a),
c AS (SELECT *, {sql_code("rest_b", 5, 5, "r")} FROM b)
"""


def residual_range(spark, d):
    """Least and greatest rest after each stage."""
    return residual_coder(spark, d).agg(*[f(f"rest_{c}").alias(f"{n}_{c}") for c in "gbr" for n, f in (("least", F.min), ("most", F.max))])


def srgb(spark, d):
    v = F.col("v")
    return spark.range(256).withColumnRenamed("id", "v").select("v", F.round(ch.linear(v), 9).alias("linear"), F.round(ch.linear(v, 0.004045), 9).alias("linear_low_threshold"), (v / 255.0).alias("unit"))


SRGB_SQL = """
SELECT v, round(CASE WHEN v / 255.0::DOUBLE <= 0.04045::DOUBLE THEN v / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((v / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END, 9) AS linear,
round(CASE WHEN v / 255.0::DOUBLE <= 0.004045::DOUBLE THEN v / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((v / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END, 9) AS linear_low_threshold, v / 255.0::DOUBLE AS unit
FROM range(256) s(v)
"""


def quantisers(spark, d):
    v = F.col("v")
    parts = [spark.range(256).withColumnRenamed("id", "v").select(F.lit(w).cast("long").alias("width"), "v", ch.truncated(v, w).alias("truncated"), ch.nearest(v, w).alias("nearest")) for w in range(1, 9)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUANTISERS_SQL = """
WITH a AS (SELECT width, v, (v >> (8 - width)) << (8 - width) AS k0 FROM range(1, 9) s(width), range(256) t(v)),
b AS (SELECT *, k0 | (k0 >> width) AS k1 FROM a), c AS (SELECT *, k1 | (k1 >> (2 * width)) AS k2 FROM b)
SELECT width, v, k2 | (k2 >> (3 * width)) AS truncated,
CAST(floor(v / 255.0::DOUBLE * ((1 << width) - 1) + 0.5::DOUBLE * (1 << (8 - width)) * ((1 << width) - 1) / 255.0::DOUBLE) AS BIGINT) AS nearest FROM c
"""


def quantiser_table(spark, d):
    """For each level: its 8-bit value, and the closest ones with the lowest bit cleared and set (one bit less is free)."""
    out = None
    for w in range(2, 9):
        v = F.col("v")
        each = spark.range(256).withColumnRenamed("id", "v").withColumn("level", ch.nearest(v, w))
        pick = lambda low, w=w: ch.spread(F.shiftleft(F.shiftright(F.col("level"), 1), 1).bitwiseOR(F.lit(low).cast("long")), w)
        some = each.groupBy("level").agg(F.count("*").alias("n")).select(F.lit(w).cast("long").alias("width"), "level", "n", ch.spread(F.col("level"), w).alias("free"), pick(0).alias("cleared"), pick(1).alias("set"))
        out = some if out is None else out.unionByName(some)
    return out


def _sql_spread(x: str, w: str) -> str:
    k0 = f"(({x}) << (8 - {w}))"
    k1 = f"({k0} | ({k0} >> {w}))"
    k2 = f"({k1} | ({k1} >> (2 * {w})))"
    return f"({k2} | ({k2} >> (3 * {w})))"


QUANTISER_TABLE_SQL = f"""
WITH a AS (SELECT width, CAST(floor(v / 255.0::DOUBLE * ((1 << width) - 1) + 0.5::DOUBLE * (1 << (8 - width)) * ((1 << width) - 1) / 255.0::DOUBLE) AS BIGINT) AS level FROM range(2, 9) s(width), range(256) t(v)),
b AS (SELECT width, level, count(*) AS n FROM a GROUP BY width, level)
SELECT width, level, n, {_sql_spread("level", "width")} AS free, {_sql_spread("(level >> 1) << 1", "width")} AS cleared, {_sql_spread("((level >> 1) << 1) | 1", "width")} AS set FROM b
"""


def odd_floor(spark, d):
    x = F.col("k") / 4.0
    return grid(spark, k=range(-64, 65)).select("k", (F.pmod(F.floor(x), F.lit(2)) == 1).alias("odd"))


def division(spark, d):
    """For which shifts a rounded-up reciprocal divides all of -127 to 127 exactly, towards zero."""
    each = grid(spark, divisor=range(5, 8, 2), shift=range(6, 19), i=range(-127, 128))
    m = F.floor(F.pow(F.lit(2.0), F.col("shift")) / F.col("divisor")) + 1
    found = F.floor(F.col("i") * m / F.pow(F.lit(2.0), F.col("shift"))) + F.when(F.col("i") < 0, 1).otherwise(0)
    want = F.when(F.col("i") < 0, -F.floor(-F.col("i") / F.col("divisor"))).otherwise(F.floor(F.col("i") / F.col("divisor")))
    return each.select("divisor", "shift", m.alias("multiplier"), (found == want).alias("ok")).groupBy("divisor", "shift", "multiplier").agg(F.bool_and("ok").alias("exact"))


DIVISION_SQL = """
WITH a AS (SELECT divisor, shift, i, CAST(floor(pow(2, shift) / divisor) AS BIGINT) + 1 AS m FROM range(5, 8, 2) s(divisor), range(6, 19) t(shift), range(-127, 128) u(i))
SELECT divisor, shift, m AS multiplier, bool_and(floor(i * m / pow(2, shift)) + CASE WHEN i < 0 THEN 1 ELSE 0 END = trunc(i / divisor)) AS exact FROM a GROUP BY divisor, shift, m
"""


def division_search(spark, d):
    """All (N, A, S, O) with floor((floor(x * N / 2^16) + A * x) / 2^S) + O * (x < 0) = x / divisor, towards zero.

    x runs over i * m * 32 for i of -127 to 127 and m of 0 to the divisor; the first x that fails ends the trial.
    """
    each = grid(spark, divisor=range(5, 8, 2), shift=range(4), add=range(2), one=range(2), factor=range(1 << 16))
    tried = {k: sorted({i * m * 32 for i in range(-127, 128) for m in range(k + 1)}, key=lambda x: (abs(x) % 7 != 6, -abs(x), x)) for k in (5, 7)}

    def fits(x):
        made = F.floor((F.floor(x * F.col("factor") / 65536) + F.col("add") * x) / F.pow(F.lit(2.0), F.col("shift"))) + F.when(x < 0, F.col("one")).otherwise(0)
        return made == F.when(x < 0, -F.floor(-x / F.col("divisor"))).otherwise(F.floor(x / F.col("divisor")))

    xs = [F.array(*[F.lit(x).cast("long") for x in some]) for some in tried.values()]
    # near the largest x only one factor in some thousands passes, so that few meet the whole list
    first = F.lit(127 * 32).cast("long")
    some = each.where(fits(first * F.col("divisor")) & fits(first))
    return some.where(F.forall(F.when(F.col("divisor") == 5, xs[0]).otherwise(xs[1]), fits)).select("divisor", F.col("factor").alias("n"), F.col("add").alias("a"), F.col("shift").alias("s"), F.col("one").alias("o"))


DIVISION_SEARCH_SQL = """
WITH c AS MATERIALIZED (SELECT divisor, s, a, o, n FROM range(5, 8, 2) d(divisor), range(4) q(s), range(2) t(a), range(2) u(o), range(65536) v(n)
  WHERE ((((127 * 32 * divisor * n) >> 16) + a * 127 * 32 * divisor) >> s) = 127 * 32 AND (((127 * 32 * n) >> 16) + a * 127 * 32) >> s = (127 * 32) // divisor),
x AS (SELECT DISTINCT divisor, i * m * 32 AS x FROM range(5, 8, 2) d(divisor), range(-127, 128) s(i), range(8) t(m) WHERE m <= divisor)
SELECT c.divisor, n, a, s, o FROM c JOIN x ON x.divisor = c.divisor GROUP BY c.divisor, n, a, s, o
HAVING bool_and(CAST(floor((floor(x * n / 65536.0::DOUBLE) + a * x) / pow(2, s)) AS BIGINT) + CASE WHEN x < 0 THEN o ELSE 0 END = CAST(trunc(x / c.divisor) AS BIGINT))
"""


def interpolants(spark, d):
    each = grid(spark, s=range(256), e=range(256), k=range(5, 8, 2), f=range(1, 7)).where("f < k")
    value = F.floor(((F.col("k") - F.col("f")) * F.col("s") + F.col("f") * F.col("e")) / F.col("k"))
    return each.groupBy("k", "f", "s").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value * (F.col("e") + 1)).alias("moment"))


def endpoints(spark, d):
    """Endpoint values of 4 to 8 bits, as they are and with the shared lowest bit cleared and set."""
    out = None
    for w in range(4, 9):
        v = F.col("v")
        clear, put = v.bitwiseAND(F.lit(~1).cast("long")), v.bitwiseOR(F.lit(1).cast("long"))
        some = spark.range(1 << w).withColumnRenamed("id", "v").select(F.lit(w).cast("long").alias("width"), "v", *[ch.endpoint(x, w).alias(n) for n, x in (("free", v), ("cleared", clear), ("set", put))])
        out = some if out is None else out.unionByName(some)
    return out


ENDPOINTS_SQL = "SELECT width, v, " + ", ".join(f"(({x}) * (1 << width) + ({x})) >> (2 * width - 8) AS {n}" for n, x in (("free", "v"), ("cleared", "v & ~1::BIGINT"), ("set", "v | 1"))) + " FROM range(4, 9) s(width), range(256) t(v) WHERE v < (1 << width)"


def weights(spark, d):
    rows = [(n, i, w) for n, some in ch.WEIGHTS.items() for i, w in enumerate(some)]
    return spark.createDataFrame(rows, "index_bits long, idx long, weight long")


WEIGHTS_SQL = "SELECT n AS index_bits, i AS idx, CAST(floor((64 * i + floor(((1 << n) - 1) / 2)) / ((1 << n) - 1)) AS BIGINT) AS weight FROM range(1, 5) s(n), range(16) t(i) WHERE i < (1 << n)"


def pyramid(spark, d):
    """Directions on the square pyramid: scaled so that the greater of |x| and |y|, and z, add up to 1."""
    n = F.greatest(F.abs("x"), F.abs("y")) + F.col("z")
    out = directions(spark).where(n > 0).select("x", "y", "z", *[(F.col(c) / n).alias(w) for c, w in zip("xyz", "uvw")])
    return out.select("*", (F.greatest(F.abs("u"), F.abs("v")) + F.col("w")).alias("p"), F.when(F.col("x") ** 2 + F.col("y") ** 2 <= 1, F.sqrt(1 - (F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("normal_z"))


PYRAMID_SQL = """
WITH g AS (SELECT i / 8.0::DOUBLE AS x, j / 8.0::DOUBLE AS y, k / 8.0::DOUBLE AS z FROM range(-8, 9) a(i), range(-8, 9) b(j), range(0, 9) c(k) WHERE NOT (i = 0 AND j = 0 AND k = 0)),
h AS (SELECT *, greatest(abs(x), abs(y)) + z AS n FROM g), q AS (SELECT x, y, z, x / n AS u, y / n AS v, z / n AS w FROM h WHERE n > 0)
SELECT *, greatest(abs(u), abs(v)) + w AS p, CASE WHEN x * x + y * y <= 1 THEN sqrt(1 - (x * x + y * y)) END AS normal_z FROM q
"""


def vectors(spark, d):
    """Four-component arithmetic on each three neighbouring quads of each embedding: a, b and c."""
    at = lambda o, k: F.element_at("e", o + k + 1).cast("double")
    four = lambda f: F.array(*[f(at(0, k), at(4, k), at(8, k)) for k in range(4)])
    made = {
        "splat_x": lambda a, b, c: at(0, 0), "splat_w": lambda a, b, c: at(0, 3), "total": lambda a, b, c: a + b, "difference": lambda a, b, c: a - b, "product": lambda a, b, c: a * b,
        "multiply_add": lambda a, b, c: a * b + c, "negative_multiply_subtract": lambda a, b, c: -(a * b - c), "reciprocal": lambda a, b, c: F.when(a != 0, 1 / a),
        "least": lambda a, b, c: F.least(a, b), "most": lambda a, b, c: F.greatest(a, b), "truncated": lambda a, b, c: (a * 100).cast("long").cast("double"),
    }
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.size("embedding") / 4) - 3))
    each = fixtures.embeddings(spark, d).withColumn("quad", starts).select("vec_id", "quad", F.slice("embedding", (F.col("quad") * 4 + 1).cast("int"), 12).alias("e"))
    rows = each.select("vec_id", "quad", F.posexplode(F.arrays_zip(*[four(f).alias(n) for n, f in made.items()])).alias("lane", "x"), F.exists(four(lambda a, b, c: a - b), lambda x: x < 0).alias("any_less"))
    return rows.select("vec_id", "quad", F.col("lane").cast("long").alias("lane"), *[F.col("x")[n].alias(n) for n in made], "any_less")


VECTORS_SQL = """
WITH v AS (SELECT vec_id, quad, list_slice(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 4 * quad + 1, 4 * quad + 12) AS e FROM embeddings, range(14) q(quad)),
l AS (SELECT vec_id, quad, lane, e[lane + 1] AS a, e[lane + 5] AS b, e[lane + 9] AS c, e FROM v, range(4) s(lane))
SELECT vec_id, quad, lane, e[1] AS splat_x, e[4] AS splat_w, a + b AS total, a - b AS difference, a * b AS product, a * b + c AS multiply_add, -(a * b - c) AS negative_multiply_subtract,
CASE WHEN a <> 0 THEN 1 / a END AS reciprocal, least(a, b) AS least, greatest(a, b) AS most, trunc(a * 100) + 0.0::DOUBLE AS truncated, e[1] < e[5] OR e[2] < e[6] OR e[3] < e[7] OR e[4] < e[8] AS any_less FROM l
"""


def half_decode(spark, d):
    """All 65536 bit patterns, unsigned and signed; infinities and what is no number as null, by kind."""
    h = F.col("h")
    out = spark.range(1 << 16).withColumnRenamed("id", "h")
    for n, s in (("unsigned", False), ("signed", True)):
        x = halves.decode(h, s)
        fine = F.pmod(F.shiftright(h, 10 if s else 11), F.lit(32)) != 31
        out = out.withColumn(n, F.when(fine, x)).withColumn(f"{n}_nan", F.isnan(x))
    return out


def _sql_half(n: str, m: int) -> str:
    e, f = f"((h >> {m}) % 32)", f"(h % {1 << m})"
    size = f"CASE WHEN {e} = 0 THEN {f} * pow(2.0::DOUBLE, {-14 - m}) ELSE (1 + {f} * pow(2.0::DOUBLE, {-m})) * pow(2.0::DOUBLE, {e} - 15) END"
    sign = "CASE WHEN h >= 32768 THEN -1 ELSE 1 END * " if m == 10 else ""
    return f"CASE WHEN {e} <> 31 THEN {sign}({size}) END AS {n}, {e} = 31 AND {f} <> 0 AS {n}_nan"


HALF_DECODE_SQL = f"SELECT h, {_sql_half('unsigned', 11)}, {_sql_half('signed', 10)} FROM range(65536) s(h)"


def half_encode(spark, d):
    """Numbers a little above each unsigned half, and their negatives, encoded again: truncation gives the half back."""
    x = halves.decode(F.col("h"), False)
    each = spark.range(31 << 11).withColumnRenamed("id", "h").select("h", (x * 1.0001).alias("x"))
    return each.select("h", halves.encode(F.col("x"), False).alias("unsigned"), halves.encode(F.col("x"), True).alias("signed"), halves.encode(-F.col("x"), True).alias("negative"), halves.encode(-F.col("x"), False).alias("negative_unsigned"))


HALF_ENCODE_SQL = "SELECT h, h AS unsigned, h >> 1 AS signed, (h >> 1) + CASE WHEN h > 0 THEN 32768 ELSE 0 END AS negative, 0::BIGINT AS negative_unsigned FROM range(63488) s(h)"

QUERIES = {
    "sc1_reconstructor": reconstructor, "sc2_reconstruct": reconstruct, "sc3_sc4_residual_coder": residual_coder, "agg13_residual_range": residual_range, "sc5_sc6_srgb": srgb, "sc7_sc8_quantisers": quantisers, "sc9_quantiser_table": quantiser_table,
    "sc10_odd_floor": odd_floor, "sc11_division": division, "sc11_division_search": division_search, "sc12_interpolants": interpolants, "sc13_sc15_endpoints": endpoints, "sc14_weights": weights, "src6_sc17_sc29_pyramid": pyramid, "sc19_sc23_vectors": vectors, "sc24_sc25_half_decode": half_decode, "sc26_sc27_half_encode": half_encode,
}
SQL = {
    "sc1_reconstructor": "SELECT width, CAST(list_sum(list_transform(range(1, CAST(floor(32 / width) AS BIGINT) + 1), lambda k: CAST(pow(2, 32 - k * width) AS BIGINT))) AS BIGINT) AS multiplier FROM range(1, 17) s(width)",
    "sc2_reconstruct": RECONSTRUCT_SQL,
    "sc3_sc4_residual_coder": f"WITH {CODER_SQL} SELECT * FROM c",
    "agg13_residual_range": f"WITH {CODER_SQL} SELECT " + ", ".join(f"{f}(rest_{c}) AS {n}_{c}" for c in "gbr" for n, f in (("least", "min"), ("most", "max"))) + " FROM c",
    "sc5_sc6_srgb": SRGB_SQL,
    "sc7_sc8_quantisers": QUANTISERS_SQL,
    "sc9_quantiser_table": QUANTISER_TABLE_SQL,
    "sc10_odd_floor": "SELECT k, CAST(floor(k / 4.0) AS BIGINT) & 1 = 1 AS odd FROM range(-64, 65) s(k)",
    "sc11_division": DIVISION_SQL,
    "sc12_interpolants": "SELECT k, f, s, min(v) AS least, max(v) AS most, CAST(sum(v * (e + 1)) AS BIGINT) AS moment FROM (SELECT s, e, k, f, ((k - f) * s + f * e) // k AS v FROM range(256) a(s), range(256) b(e), range(5, 8, 2) c(k), range(1, 7) q(f) WHERE f < k) GROUP BY k, f, s",
    "sc11_division_search": DIVISION_SEARCH_SQL,
    "sc13_sc15_endpoints": ENDPOINTS_SQL,
    "sc14_weights": WEIGHTS_SQL,
    "src6_sc17_sc29_pyramid": PYRAMID_SQL,
    "sc19_sc23_vectors": VECTORS_SQL,
    "sc24_sc25_half_decode": HALF_DECODE_SQL,
    "sc26_sc27_half_encode": HALF_ENCODE_SQL,
}
