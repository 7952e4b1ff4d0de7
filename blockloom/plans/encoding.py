"""Queries on our own encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import images
from blockloom.functions.channels import number
from blockloom.operators import decode, encode, errors, single_colour
from blockloom.operators.lookups import colour_table
from blockloom.plans.tables import COLOUR_CTE, FIRST, _best, _sides, first_texels, sql_replicate
from blockloom.sources import fixtures
from blockloom.sources.generators import one_colour, one_colour_random, two_colours


def encoded(spark, d):
    found = encode.range_fit(fixtures.blocks(spark, d).select("vec_id", "e"), ["vec_id"])
    return found.select("vec_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("bytes"))


def round_trip(spark, d):
    """Encodes and decodes every block: its error, by label as the harness sums up."""
    found = encode.range_fit(fixtures.blocks(spark, d).select("vec_id", "e"), ["vec_id"]).withColumn("block", F.lit(0).cast("long"))
    back = decode.bc1(found, False).select("vec_id", "texel", *[F.col(c).alias(f"{c}_q") for c in "rgb"])
    each = errors.block_error(fixtures.texels(spark, d).join(back, ["vec_id", "texel"]), ["label", "vec_id"], [(c, f"{c}_q") for c in "rgb"])
    return each.groupBy("label").agg(F.sqrt(F.min("error")).alias("least"), F.sqrt(F.max("error")).alias("most"), F.sqrt(F.avg("error")).alias("rms"))


def by_codec(codec: str, metric: str):
    def run(spark, d):
        found = encode.compressed(fixtures.blocks(spark, d).select("vec_id", "e"), ["vec_id"], codec, metric)
        return found.select("vec_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("bytes"))

    return run


def generated(spark):
    """(id, e) of the harness: blocks of one colour, of one colour drawn at random, and of two; id holds kind and both colours."""
    alone = lambda c, v: [F.when(F.col(c) == k, F.col(v)).otherwise(0) for k in range(3)]
    one = one_colour(spark).select(F.lit("one_colour").alias("kind"), (F.col("channel") * 256 + F.col("value")).alias("n"), F.array(*"rgb").alias("upper"), F.array(*"rgb").alias("lower"))
    drawn = one_colour_random(spark).select(F.lit("random").alias("kind"), F.col("test").alias("n"), F.array(*"rgb").alias("upper"), F.array(*"rgb").alias("lower"))
    two = two_colours(spark).select(F.lit("two_colours").alias("kind"), ((F.col("channel") * 256 + F.col("v1")) * 256 + F.col("v2")).alias("n"), F.array(*alone("channel", "v1")).alias("upper"), F.array(*alone("channel", "v2")).alias("lower"))
    half = lambda c: F.concat(*[F.concat(F.col(c), F.array(number(255)))] * 8)
    return one.unionByName(drawn).unionByName(two).select(F.struct("kind", "n", "upper", "lower").alias("vec_id"), F.concat(half("upper"), half("lower")).alias("e"))


def harness(spark, d):
    """Encodes and decodes the generated blocks: least, greatest and mean-square error by kind, as the harness sums up."""
    found = encode.range_fit(generated(spark), ["vec_id"]).withColumn("block", F.lit(0).cast("long"))
    back = decode.bc1(found, False)
    own = F.when(F.col("texel") < 8, F.col("vec_id.upper")).otherwise(F.col("vec_id.lower"))
    each = back.withColumn("own", own).groupBy("vec_id").agg((F.sum(errors.squared(*[(F.element_at("own", k + 1), F.col(c)) for k, c in enumerate("rgb")])) / 16).alias("error"))
    return each.groupBy("vec_id.kind").agg(F.count("*").alias("n"), F.sqrt(F.min("error")).alias("least"), F.sqrt(F.max("error")).alias("most"), F.sqrt(F.avg("error")).alias("rms"))


def block_bytes(spark, d):
    """Each embedding's first texel as a block of one colour, in bytes, and the colour that they decode to."""
    best = single_colour.best(single_colour.candidates(first_texels(spark, d), colour_table(spark), ["vec_id"]), ["vec_id"])
    found = single_colour.block_bytes(best, ["vec_id"]).withColumn("block", F.lit(0).cast("long"))
    back = decode.bc1(found, False).where("texel = 5").select("vec_id", "r", "g", "b")
    return found.select("vec_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("bytes")).join(back, "vec_id")


def same_sizes(spark, d):
    """Whether images of two sizes can be compared."""
    from blockloom.sources.generators import grid

    each = grid(spark, w=range(4, 20, 4), h=range(4, 20, 4), other_w=range(4, 20, 4), other_h=range(4, 20, 4))
    return each.select("w", "h", "other_w", "other_h", images.same_size(*[F.col(c) for c in ("w", "h", "other_w", "other_h")]).alias("same"))


def option_letters(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in images.OPTIONS.items()], "letter string, setting string, value string")


def mixed_halves(spark, d):
    c = fixtures.codes(spark, d, 16)
    own = c.select("vec_id", "block", decode.little(0, 2).alias("a"), decode.little(2, 2).alias("b"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.pmod(F.element_at("c", (F.pmod(t, F.lit(12)) + 5).cast("int")), F.lit(4))).alias("codes"))
    return encode.mixed_half(own, ["vec_id", "block"])


def _box(tex: str = "", metric: str = "uniform") -> str:
    w = encode.METRICS[metric]
    err = " + ".join(f"{x} * (t.{c} - q_{c}) * (t.{c} - q_{c})" for x, c in zip(w, "rgb"))
    ends = ", ".join(f"{f}({c}) >> {8 - w} AS {n}_{c}" for c, w in encode.WIDTHS for n, f in (("h", "max"), ("l", "min")))
    wide = ", ".join(f"{sql_replicate(f'{n}_{c}', w)} AS p{n}_{c}" for c, w in encode.WIDTHS for n in "hl")
    p = {c: [f"ph_{c}", f"pl_{c}", f"(2 * ph_{c} + pl_{c}) // 3", f"(ph_{c} + 2 * pl_{c}) // 3"] for c in "rgb"}
    level = lambda c: "CASE code " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(p[c])) + " END"
    return f"""{tex or fixtures.SQL_TEXELS}, box AS (SELECT vec_id, {ends} FROM tex GROUP BY vec_id), pal AS (SELECT *, (h_r << 11) + (h_g << 5) + h_b AS c0, (l_r << 11) + (l_g << 5) + l_b AS c1, {wide} FROM box),
    lev AS (SELECT vec_id, c0, c1, code, {", ".join(f"{level(c)} AS q_{c}" for c in "rgb")} FROM pal, range(4) s(code) WHERE c0 <> c1 OR code = 0),
    cod AS (SELECT t.vec_id, t.label, t.texel, c0, c1, code, {err} AS err, row_number() OVER (PARTITION BY t.vec_id, t.texel ORDER BY {err}, code) AS o FROM tex t JOIN lev ON lev.vec_id = t.vec_id)"""


WORD_SQL = "w AS (SELECT vec_id, c0, c1, texel // 4 AS k, CAST(sum(code << (2 * (texel % 4))) AS BIGINT) AS v FROM cod WHERE o = 1 GROUP BY vec_id, c0, c1, texel // 4), col AS (SELECT vec_id, concat_ws(',', c0 & 255, c0 >> 8, c1 & 255, c1 >> 8, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS bytes FROM w GROUP BY vec_id, c0, c1)"


def codec_sql(codec: str, metric: str) -> str:
    if codec == "bc1":
        return f"WITH {_box(metric=metric)}, {WORD_SQL} SELECT vec_id, bytes FROM col"
    if codec == "bc2":
        alpha = "alp AS (SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k) AS alpha FROM (SELECT vec_id, texel // 2 AS k, CAST(sum(((a + 8) // 17) << (4 * (texel % 2))) AS BIGINT) AS v FROM tex GROUP BY vec_id, texel // 2) GROUP BY vec_id)"
    else:
        levels = ", ".join(["a0", "a1", *[f"({7 - k} * a0 + {k} * a1) // 7" for k in range(1, 7)]])
        alpha = f"""ram AS (SELECT vec_id, max(a) AS a0, min(a) AS a1 FROM tex GROUP BY vec_id), lv AS (SELECT vec_id, a0, a1, [{levels}] AS l FROM ram),
        ac AS (SELECT t.vec_id, texel, a0, a1, CASE WHEN a0 = a1 THEN 0 ELSE list_position(list_transform(l, lambda m: abs(a - m)), list_min(list_transform(l, lambda m: abs(a - m)))) - 1 END AS code FROM tex t JOIN lv ON lv.vec_id = t.vec_id),
        ah AS (SELECT vec_id, a0, a1, texel // 8 AS h, CAST(sum(code::BIGINT << (3 * (texel % 8))) AS BIGINT) AS v FROM ac GROUP BY vec_id, a0, a1, texel // 8),
        alp AS (SELECT vec_id, concat_ws(',', a0, a1, string_agg(concat_ws(',', v & 255, (v >> 8) & 255, v >> 16), ',' ORDER BY h)) AS alpha FROM ah GROUP BY vec_id, a0, a1)"""
    return f"WITH {_box(metric=metric)}, {WORD_SQL}, {alpha} SELECT vec_id, alpha || ',' || bytes AS bytes FROM col JOIN alp USING (vec_id)"


_two = "SELECT 'two_colours' AS label, c, v1, v2 FROM range(3) s(c), range(255) t(v1), range(255) u(v2) WHERE v1 < v2 UNION ALL SELECT 'one_colour', c, v, v FROM range(3) s(c), range(255) t(v)"
_rand = ", ".join(f"((((t * 3 + {k}) * 1103515245 + 12345) % 2147483648) // 65536) % 256 AS {c}" for k, c in enumerate("rgb", 1))
GENERATED = f"""gen AS MATERIALIZED (SELECT row_number() OVER () AS vec_id, * FROM (SELECT label, {', '.join(f'CASE WHEN c = {k} THEN v1 ELSE 0 END AS {n}1, CASE WHEN c = {k} THEN v2 ELSE 0 END AS {n}2' for k, n in enumerate('rgb'))} FROM ({_two}) UNION ALL SELECT 'random', r, r, g, g, b, b FROM (SELECT {_rand} FROM range(1000) s(t)))),
tex AS (SELECT vec_id, label, texel, {', '.join(f'CASE WHEN texel < 8 THEN {n}1 ELSE {n}2 END AS {n}' for n in 'rgb')} FROM gen, range(16) s(texel))"""
_c0, _c1 = ("(({0}_{1} << 11) + (g_{1} << 5) + b_{1})".format("r", e) for e in ("first", "last"))
_flip = f"CASE WHEN steps = 4 THEN {_c0} < {_c1} ELSE {_c0} > {_c1} END"
_back = ", ".join(f"CASE WHEN side = 0 THEN {sql_replicate(f'{c}_first', w)} WHEN steps = 4 THEN (2 * {sql_replicate(f'{c}_first', w)} + {sql_replicate(f'{c}_last', w)}) // 3 ELSE ({sql_replicate(f'{c}_first', w)} + {sql_replicate(f'{c}_last', w)}) // 2 END AS {c}" for c, w in single_colour.CHANNELS)

QUERIES = {
    "own_range_fit": encoded, "own_range_fit_round_trip": round_trip, "fit8_mixed_half": mixed_halves,
    **{f"own_{c}_{m}": by_codec(c, m) for c, m in (("bc1", "perceptual"), ("bc2", "uniform"), ("bc3", "perceptual"))},
    "agg4_src4_src5_harness": harness, "fit3_block_bytes": block_bytes, "flt4_same_sizes": same_sizes, "prj7_options": option_letters,
}
SQL = {
    "own_range_fit": f"WITH {_box()}, w AS (SELECT vec_id, c0, c1, texel // 4 AS k, CAST(sum(code << (2 * (texel % 4))) AS BIGINT) AS v FROM cod WHERE o = 1 GROUP BY vec_id, c0, c1, texel // 4) SELECT vec_id, concat_ws(',', c0 & 255, c0 >> 8, c1 & 255, c1 >> 8, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS bytes FROM w GROUP BY vec_id, c0, c1",
    "own_range_fit_round_trip": f"WITH {_box()}, er AS (SELECT vec_id, label, CAST(sum(err) AS DOUBLE) / 16 AS error FROM cod WHERE o = 1 GROUP BY vec_id, label) SELECT label, sqrt(min(error)) AS least, sqrt(max(error)) AS most, sqrt(avg(error)) AS rms FROM er GROUP BY label",
    "fit8_mixed_half": f"""WITH {fixtures.sql_codes(16)}, h AS (SELECT vec_id, block, c[1] + (c[2] << 8) AS a, c[3] + (c[4] << 8) AS b, list_transform(range(16), lambda t: c[t % 12 + 5] % 4) AS s FROM cod),
    g AS (SELECT *, (s[1] >> 1) <> ((a >> 5) + (b >> 5)) % 2 AS swap FROM h), w AS (SELECT vec_id, block, CASE WHEN swap THEN b ELSE a END AS x, CASE WHEN swap THEN a ELSE b END AS y, CASE WHEN swap THEN list_transform(s, lambda q: 3 - q) ELSE s END AS s FROM g)
    SELECT vec_id, block, CAST(list_sum(list_transform(range(16), lambda t: s[t + 1] << (2 * t))) AS BIGINT) AS low, (((y >> 11) << 10) + (((y >> 6) & 31) << 5) + (y & 31) << 15) + ((x >> 11) << 10) + (((x >> 6) & 31) << 5) + (x & 31) AS colours, (y >> 5) & 1 AS bit FROM w""",
    **{f"own_{c}_{m}": codec_sql(c, m) for c, m in (("bc1", "perceptual"), ("bc2", "uniform"), ("bc3", "perceptual"))},
    "agg4_src4_src5_harness": f"WITH {_box(GENERATED)}, er AS (SELECT vec_id, label, CAST(sum(err) AS DOUBLE) / 16 AS error FROM cod WHERE o = 1 GROUP BY vec_id, label) SELECT label AS kind, count(*) AS n, sqrt(min(error)) AS least, sqrt(max(error)) AS most, sqrt(avg(error)) AS rms FROM er GROUP BY label",
    "fit3_block_bytes": f"""WITH {COLOUR_CTE}, {FIRST}, {_sides('one', 'p.vec_id')}, {_best('vec_id')}, k AS (SELECT vec_id, {_c0} AS p, {_c1} AS q, {_flip} AS flip, CASE WHEN {_flip} THEN CASE WHEN side = 0 THEN 1 WHEN steps = 4 THEN 3 ELSE 2 END ELSE side * 2 END AS code, {_back} FROM pick WHERE o = 1),
    m AS (SELECT *, CASE WHEN flip THEN q ELSE p END AS c0, CASE WHEN flip THEN p ELSE q END AS c1 FROM k) SELECT vec_id, concat_ws(',', c0 & 255, c0 >> 8, c1 & 255, c1 >> 8, code * 85, code * 85, code * 85, code * 85) AS bytes, r, g, b FROM m""",
    "flt4_same_sizes": "SELECT w, h, other_w, other_h, w = other_w AND h = other_h AS same FROM range(4, 20, 4) s(w), range(4, 20, 4) t(h), range(4, 20, 4) u(other_w), range(4, 20, 4) v(other_h)",
    "prj7_options": f"SELECT * FROM (VALUES {', '.join(repr((k, *v)) for k, v in images.OPTIONS.items())}) v(letter, setting, value)",
}
