"""Queries on block decoding, tilings, addresses and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.operators import decode, errors, layout, lookups
from blockloom.plans.tables import sql_replicate
from blockloom.sources import fixtures
from blockloom.sources.generators import grid, one_colour_random, two_colours, with_channels


# what DuckDB is told; bytes are c[1] and on
def b(k: int | str) -> str:
    return f"c[{k + 1}]" if isinstance(k, int) else f"c[CAST({k} AS BIGINT) + 1]"


def little(first: int, count: int) -> str:
    return "(" + " + ".join(f"({b(first + k)} << {8 * k})" for k in range(count)) + ")"


def big(first: int, count: int) -> str:
    return "(" + " + ".join(f"({b(first + k)} << {8 * (count - 1 - k)})" for k in range(count)) + ")"


def part(x: str, low: int, count: int) -> str:
    return f"(({x} >> {low}) & {(1 << count) - 1})"


def span(low: int, count: int) -> str:
    first, last = low // 8, (low + count - 1) // 8
    return part(little(first, last - first + 1), low % 8, count)


def pick(code: str, options: list[str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(options)) + " END"


def two_bits(first: int) -> str:
    return f"(({b(f'{first} + texel // 4')} >> (2 * (texel % 4))) & 3)"


def rgb565(x: str) -> list[str]:
    return [sql_replicate(part(x, 11, 5), 5), sql_replicate(part(x, 5, 6), 6), sql_replicate(part(x, 0, 5), 5)]


def sql_colours(first: int, four: str) -> list[str]:
    c0, c1, code = little(first, 2), little(first + 2, 2), two_bits(first + 4)
    test = four or f"{c0} > {c1}"
    return [pick(code, [p, q, f"CASE WHEN {test} THEN (2 * {p} + {q}) // 3 ELSE ({p} + {q}) // 2 END", f"CASE WHEN {test} THEN ({p} + 2 * {q}) // 3 ELSE 0 END"]) for p, q in zip(rgb565(c0), rgb565(c1))]


def sql_decode(size: int, rgba: list[str], n: int = 16, extra: str = "") -> str:
    return f"WITH {fixtures.sql_codes(size)} SELECT vec_id, block, {extra} texel, " + ", ".join(f"CAST({x} AS BIGINT) AS {c}" for x, c in zip(rgba, "rgba")) + f" FROM cod, range({n}) s(texel)"


BC2_ALPHA = f"(({b('texel // 2')} >> (4 * (texel % 2))) & 15) * 17"
_half = f"CASE WHEN texel < 8 THEN {little(2, 3)} ELSE {little(5, 3)} END"
_code3 = f"((({_half}) >> (3 * (texel % 8))) & 7)"
_seven = [b(0), b(1), *[f"({7 - k} * {b(0)} + {k} * {b(1)}) // 7" for k in range(1, 7)]]
_five = [b(0), b(1), *[f"({5 - k} * {b(0)} + {k} * {b(1)}) // 5" for k in range(1, 5)], "0", "255"]
BC3_ALPHA = f"CASE WHEN {b(0)} > {b(1)} THEN {pick(_code3, _seven)} ELSE {pick(_code3, _five)} END"


def etc1_sql() -> str:
    x, y = "(texel % 4)", "(texel // 4)"
    second = f"(CASE WHEN {b(3)} & 1 = 1 THEN {y} >= 2 ELSE {x} >= 2 END)"
    at = lambda w: f"(({w} >> ({x} * 4 + {y})) & 1)"
    table = f"(CASE WHEN {second} THEN {part(b(3), 2, 3)} ELSE {part(b(3), 5, 3)} END)"
    size = f"(CASE WHEN {at(big(6, 2))} = 0 THEN {pick(table, [str(m) for m, _ in decode.MODIFIERS])} ELSE {pick(table, [str(m) for _, m in decode.MODIFIERS])} END)"
    out = []
    for k in range(3):
        five, delta = part(b(k), 3, 5), part(b(k), 0, 3)
        moved = f"(({five} + CASE WHEN {delta} > 3 THEN {delta} - 8 ELSE {delta} END + 32) % 32)"
        base = f"(CASE WHEN {part(b(3), 1, 1)} = 1 THEN {sql_replicate(f'(CASE WHEN {second} THEN {moved} ELSE {five} END)', 5)} ELSE (CASE WHEN {second} THEN {part(b(k), 0, 4)} ELSE {part(b(k), 4, 4)} END) * 17 END)"
        out.append(f"least(255, greatest(0, {base} + CASE WHEN {at(big(4, 2))} = 1 THEN -{size} ELSE {size} END))")
    return sql_decode(8, [*out, "255"])


def fxt1_sql() -> str:
    five = lambda low: sql_replicate(span(low, 5), 5)
    colour = lambda low: [five(low + 10), five(low + 5), five(low)]
    top, clear = span(125, 3), f"{span(124, 1)} = 1"
    kind = f"CASE WHEN {top} >= 4 THEN 'mixed' WHEN {top} = 2 THEN 'chroma' WHEN {top} = 3 THEN 'alpha' ELSE 'hi' END"
    code2 = two_bits(0)
    code3 = f"((({pick('texel // 8', [little(3 * k, 3) for k in range(4)])}) >> (3 * (texel % 8))) & 7)"
    hi = [pick(code3, [p, *[f"({6 - k} * {p} + {k} * {q} + 3) // 6" for k in range(1, 6)], q, "0"]) for p, q in zip(colour(96), colour(111))]
    hi.append(f"CASE WHEN {code3} = 7 THEN 0 ELSE 255 END")
    four = [colour(64 + 15 * k) for k in range(4)]
    chroma = [*[pick(code2, [four[k][c] for k in range(4)]) for c in range(3)], "255"]

    def half(first: int, lsb: int, select: int) -> list[str]:
        p, q = colour(first), colour(first + 15)
        p[1] = f"CASE WHEN {clear} THEN {p[1]} ELSE {sql_replicate(f'({span(first + 5, 5)} * 2 + ({span(select, 1)} + {span(lsb, 1)}) % 2)', 6)} END"
        q[1] = sql_replicate(f"({span(first + 20, 5)} * 2 + {span(lsb, 1)})", 6)
        return [f"CASE WHEN {clear} THEN {pick(code2, [x, f'(({x}) + {y}) // 2', y, '0'])} ELSE {pick(code2, [x, f'(2 * ({x}) + {y} + 1) // 3', f'(({x}) + 2 * {y} + 1) // 3', y])} END" for x, y in zip(p, q)]

    mixed = [f"CASE WHEN texel >= 16 THEN {h} ELSE {low} END" for h, low in zip(half(94, 126, 33), half(64, 125, 1))]
    mixed.append(f"CASE WHEN {clear} AND {code2} = 3 THEN 0 ELSE 255 END")
    three = [[*colour(64 + 15 * k), five(109 + 5 * k)] for k in range(3)]
    alpha = []
    for c in range(4):
        x, y = f"(CASE WHEN texel >= 16 THEN {three[2][c]} ELSE {three[0][c]} END)", three[1][c]
        alpha.append(f"CASE WHEN {clear} THEN {pick(code2, [x, f'(2 * {x} + {y} + 1) // 3', f'({x} + 2 * {y} + 1) // 3', y])} ELSE {pick(code2, [three[0][c], three[1][c], three[2][c], '0'])} END")
    rgba = [f"CASE {kind} WHEN 'hi' THEN {h} WHEN 'chroma' THEN {c} WHEN 'mixed' THEN {m} ELSE {a} END" for h, c, m, a in zip(hi, chroma, mixed, alpha)]
    return sql_decode(16, rgba, 32, f"{kind} AS kind,")


#: Mip levels of the paletted images, which are 8 wide.
MIPS = 3
PALETTED = [(form, w) for form in decode.PALETTE_FORMATS for w in (False, True)]


def paletted(spark, d):
    """Each page as a paletted image of one of the ten formats, as high as its bytes fill all levels: what each level sums up to."""
    own = lambda values, t: F.element_at(F.array(*[F.lit(v).cast(t) for v in values]), (F.pmod("page_id", F.lit(10)) + 1).cast("int"))
    pages = fixtures.dealt(spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", "html"))
    images = pages.select("page_id", own([f for f, _ in PALETTED], "string").alias("form"), own([w for _, w in PALETTED], "boolean").alias("wide"), F.octet_length("html").alias("octets"), F.encode("html", "UTF-8").alias("bytes"))
    rest = F.col("octets") - own([decode.PALETTE_FORMATS[f] * (256 if w else 16) for f, w in PALETTED], "long")
    images = images.withColumn("width", F.lit(8).cast("long")).withColumn("height", 4 * F.floor(rest / F.when(F.col("wide"), 42).otherwise(21))).where("height > 0")
    found = decode.paletted_sums(images, ["page_id"], MIPS)
    return found.groupBy("page_id", "level").agg(*[F.sum(c).alias(c) for c in ("texels", *(f"sum_{c}" for c in "rgba"))])


def paletted_sql() -> str:
    forms = ", ".join(f"({k}, '{f}', {w}, {decode.PALETTE_FORMATS[f]})" for k, (f, w) in enumerate(PALETTED))
    w = "(c[1] + (c[2] << 8))"
    entry = {
        "rgb8": ["c[1]", "c[2]", "c[3]", "255"], "rgba8": ["c[1]", "c[2]", "c[3]", "c[4]"], "r5_g6_b5": [*rgb565(w), "255"], "rgba4": [f"{part(w, k, 4)} * 17" for k in (12, 8, 4, 0)],
        "rgb5_a1": [*[sql_replicate(part(w, k, 5), 5) for k in (11, 6, 1)], f"({w} & 1) * 255"],
    }
    value = lambda k: "CASE form " + " ".join(f"WHEN '{f}' THEN {e[k]}" for f, e in entry.items()) + " END"
    levels = " UNION ALL ".join(f"SELECT page_id, form, wide, {k} AS level, {8 >> k} AS w, h >> {k} AS h, start + " + " + ".join(["0", *[f"CASE WHEN wide THEN {8 >> j} * (h >> {j}) ELSE {8 >> j} * (h >> {j}) // 2 END" for j in range(k)]]) + " AS start FROM img WHERE h > 0" for k in range(MIPS))
    return f"""WITH frm(k, form, wide, size) AS (VALUES {forms}), raw AS (SELECT page_id, {fixtures.sql_bytes('html')} AS e FROM pages WHERE html IS NOT NULL),
    img AS (SELECT *, size * CASE WHEN wide THEN 256 ELSE 16 END AS start, 4 * CAST(floor((len(e) - size * CASE WHEN wide THEN 256 ELSE 16 END) / CASE WHEN wide THEN 42 ELSE 21 END) AS BIGINT) AS h FROM raw JOIN frm ON frm.k = page_id % 10),
    lev AS ({levels}), byt AS (SELECT page_id, unnest(e) AS v, unnest(range(len(e))) AS pos FROM raw),
    pal AS (SELECT page_id, code, [max(v) FILTER (k = 0), max(v) FILTER (k = 1), max(v) FILTER (k = 2), max(v) FILTER (k = 3)] AS c FROM (SELECT page_id, v, pos // size AS code, pos % size AS k FROM byt JOIN (SELECT page_id, size, start FROM img) USING (page_id) WHERE pos < start) GROUP BY page_id, code),
    cod AS (SELECT page_id, form, level, w, CASE WHEN wide THEN pos - start ELSE 2 * (pos - start) + odd END AS i, CASE WHEN wide THEN v WHEN odd = 1 THEN v & 15 ELSE v >> 4 END AS code, h FROM byt JOIN lev USING (page_id), range(2) o(odd) WHERE pos >= start AND (odd = 0 OR NOT wide) AND CASE WHEN wide THEN pos - start ELSE 2 * (pos - start) + odd END < w * h),
    ent AS (SELECT page_id, form, level, i // w * 8 + i % w + 1 AS place, c FROM cod JOIN pal USING (page_id, code))
    SELECT page_id, level, count(*) AS texels, {', '.join(f'CAST(sum({value(k)} * place) AS BIGINT) AS sum_{n}' for k, n in enumerate('rgba'))} FROM ent GROUP BY page_id, level"""


#: Sides of the volumes that eight blocks of eight bytes make up: layers by four, and what remains.
VOLUMES = ((8, 4, 4), (4, 4, 7), (4, 8, 3), (5, 3, 3))


def volumes(spark, d):
    each = [decode.volume(fixtures.codes(spark, d, 8), *v).withColumn("sides", F.lit("x".join(map(str, v)))) for v in VOLUMES]
    return lookups.union(each)


def volumes_sql() -> str:
    parts = []
    for w, h, d in VOLUMES:
        across, down, stacked = (w + 3) // 4, (h + 3) // 4, 4 * (d // 4)
        block = f"CASE WHEN z >= {stacked} THEN {across * down * stacked} + x // 4 + {across} * (y // 4 + {down} * (z - {stacked})) ELSE 4 * (x // 4 + {across} * (y // 4 + {down} * (z // 4))) + z % 4 END"
        parts.append(f"SELECT vec_id, '{w}x{h}x{d}' AS sides, x, y, z, r, g, b, a FROM dec JOIN (SELECT x, y, z, {block} AS block, 4 * (y % 4) + x % 4 AS texel FROM range({w}) s(x), range({h}) t(y), range({d}) u(z)) USING (block, texel)")
    return f"WITH dec AS ({sql_decode(8, [*sql_colours(0, ''), '255'])}) " + " UNION ALL ".join(parts)


def volume_sizes(spark, d):
    each = grid(spark, w=range(1, 20), h=range(1, 20), d=range(1, 10))
    return each.select("w", "h", "d", *[layout.volume_size(*[F.col(c) for c in "whd"], n).alias(f"vtc_{n}") for n in (8, 16)])


def quantised_texels(spark, d):
    t = fixtures.texels(spark, d)
    return t.select("*", *[ch.truncated(F.col(c), w).alias(f"{c}_q") for c, w in (("r", 5), ("g", 6), ("b", 5))])


PAIRS = [(c, f"{c}_q") for c in "rgb"]


def min_slice(spark, d):
    """Error of RGB565 truncation, by label: mean over blocks and its root."""
    each = errors.block_error(quantised_texels(spark, d), ["label", "vec_id"], PAIRS)
    return each.groupBy("label").agg(F.count("*").alias("n_blocks"), F.avg("error").alias("mse"), F.sqrt(F.avg("error")).alias("rms"))


def block_error(spark, d):
    return errors.block_error(quantised_texels(spark, d), ["vec_id"], PAIRS)


def harness(spark, d):
    """Least, greatest and mean-square error over blocks, by label."""
    each = errors.block_error(quantised_texels(spark, d), ["label", "vec_id"], PAIRS)
    return each.groupBy("label").agg(F.sqrt(F.min("error")).alias("least"), F.sqrt(F.max("error")).alias("most"), F.sqrt(F.avg("error")).alias("rms"))


def packed_error(spark, d):
    """Opaque grey pixels packed in one number, unpacked, and their error to the quantised ones."""
    v = F.col("r")
    packed = F.lit(255 << 24).bitwiseOR(F.shiftleft(v, 16)).bitwiseOR(F.shiftleft(v, 8)).bitwiseOR(v)
    t = quantised_texels(spark, d).select("vec_id", packed.alias("p"), "r_q", "g_q", "b_q")
    t = t.select("vec_id", "p", *[ch.bits(F.col("p"), 8 * k, 8).alias(c) for k, c in enumerate("rgb")], "r_q", "g_q", "b_q")
    return t.groupBy("vec_id").agg(F.min("p").alias("least_pixel"), (F.sum(errors.squared(*[(F.col(a), F.col(q)) for a, q in PAIRS])) / 16).alias("error"))


def pixels(spark, d):
    """Each embedding as an image of 8 by 8 grey pixels."""
    each = fixtures.blocks(spark, d).select(F.col("vec_id").alias("image"), F.posexplode("e").alias("i", "v"))
    return each.select("image", F.pmod("i", F.lit(8)).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), "v")


def tiles(spark, d):
    found = layout.tiled(pixels(spark, d), ["image"], "v")
    return found.select("image", "block_y", "block_x", F.array_join(F.transform("texels", lambda x: x.cast("string")), ",").alias("texels"))


def there_and_back(spark, d):
    return layout.untiled(layout.tiled(pixels(spark, d), ["image"], "v"), ["image"], "v").select("image", "x", "y", "v")


def image_pairs(spark, d):
    """Images against their quantised selves, met by place."""
    p = pixels(spark, d)
    return errors.image_rms(p, p.withColumn("v", ch.truncated(F.col("v"), 5)), ["image"], "v")


def normalised(spark, d):
    t = fixtures.texels(spark, d).withColumn("channels", F.pmod("vec_id", F.lit(4)) + 1)
    out = layout.normalised(t.select("vec_id", "texel", "channels", *[F.col(c).alias(f"in_{c}") for c in "rgba"]), F.col("channels"), [F.col(f"in_{c}") for c in "rgba"])
    return out.select("vec_id", "texel", "channels", "r", "g", "b", "a")


def sizes(spark, d):
    each = grid(spark, w=range(1, 65), h=range(1, 65))
    fits = (F.pmod("w", F.lit(4)) == 0) & (F.pmod("h", F.lit(4)) == 0)
    return each.select("w", "h", fits.alias("whole_blocks"), *[x.alias(n) for n, x in layout.sizes(F.col("w"), F.col("h")).items()])


SIZES_SQL = """
SELECT w, h, w % 4 = 0 AND h % 4 = 0 AS whole_blocks, q * 8 AS s3tc_8, q * 16 AS s3tc_16, ((w + 7) // 8) * ((h + 3) // 4) * 16 AS fxt1, q * 8 AS atc_8, q * 16 AS atc_16,
greatest(w, 8) * greatest(h, 8) * 4 // 8 AS pvrtc_4bpp, greatest(w, 16) * greatest(h, 8) * 2 // 8 AS pvrtc_2bpp FROM (SELECT w, h, ((w + 3) // 4) * ((h + 3) // 4) AS q FROM range(1, 65) s(w), range(1, 65) t(h))
"""


def volume_blocks(spark, d):
    each = grid(spark, w=range(5, 14, 4), h=range(6, 11, 4), d=range(1, 8), x=range(0, 13), y=range(0, 10), z=range(0, 7)).where("x < w and y < h and z < d")
    return each.select("w", "h", "d", "x", "y", "z", layout.volume_block(*[F.col(c) for c in "whdxyz"], 8).alias("offset"))


VOLUME_SQL = """
SELECT w, h, d, x, y, z, CASE WHEN z >= 4 * (d // 4) THEN 8 * (aw * ah * 4 * (d // 4) + x // 4 + aw * (y // 4 + ah * (z - 4 * (d // 4)))) ELSE 32 * (x // 4 + aw * (y // 4 + ah * (z // 4))) END AS "offset"
FROM (SELECT *, (w + 3) // 4 AS aw, (h + 3) // 4 AS ah FROM range(5, 14, 4) s(w), range(6, 11, 4) t(h), range(1, 8) u(d), range(13) v(x), range(10) q(y), range(7) r(z)) WHERE x < w AND y < h AND z < d
"""


def updates(spark, d):
    each = grid(spark, x=range(10), y=range(10), w=range(1, 11), h=range(1, 11)).where("x + w <= 10 and y + h <= 10")
    return each.select("x", "y", "w", "h", layout.update_is_legal(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(10), F.lit(10)).alias("legal"))


def generated(spark, d):
    """Sizes and sums of the generated inputs."""
    two = with_channels(two_colours(spark), "v1").select(F.lit("two_colours").alias("kind"), "r", "g", "b")
    some = one_colour_random(spark).select(F.lit("random").alias("kind"), "r", "g", "b")
    one = with_channels(grid(spark, channel=range(3), value=range(255)), "value").select(F.lit("one_colour").alias("kind"), "r", "g", "b")
    return lookups.union([two, some, one]).groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "rgb"])


GENERATED_SQL = """
WITH a AS (SELECT 'two_colours' AS kind, CASE WHEN c = 0 THEN v1 ELSE 0 END AS r, CASE WHEN c = 1 THEN v1 ELSE 0 END AS g, CASE WHEN c = 2 THEN v1 ELSE 0 END AS b FROM range(3) s(c), range(255) t(v1), range(255) u(v2) WHERE v1 < v2
UNION ALL SELECT 'one_colour', CASE WHEN c = 0 THEN v ELSE 0 END, CASE WHEN c = 1 THEN v ELSE 0 END, CASE WHEN c = 2 THEN v ELSE 0 END FROM range(3) s(c), range(255) t(v)
UNION ALL SELECT 'random', ((((t * 3 + 1) * 1103515245 + 12345) % 2147483648) // 65536) % 256, ((((t * 3 + 2) * 1103515245 + 12345) % 2147483648) // 65536) % 256, ((((t * 3 + 3) * 1103515245 + 12345) % 2147483648) // 65536) % 256 FROM range(1000) s(t))
SELECT kind, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b FROM a GROUP BY kind
"""


def _q(c: str, w: int) -> str:
    k0 = f"(({c} >> {8 - w}) << {8 - w})"
    k1 = f"({k0} | ({k0} >> {w}))"
    return f"({k1} | ({k1} >> {2 * w}))"


QTEX = f"{fixtures.SQL_TEXELS}, qt AS (SELECT *, {', '.join(f'{_q(c, w)} AS {c}_q' for c, w in (('r', 5), ('g', 6), ('b', 5)))} FROM tex)"
SQ = " + ".join(f"({c} - {c}_q) * ({c} - {c}_q)" for c in "rgb")
PIX = f"{fixtures.SQL_BLOCKS}, pix AS (SELECT vec_id AS image, i % 8 AS x, i // 8 AS y, e[i + 1] AS v FROM blk, range(64) s(i))"

QUERIES = {
    "min_slice_quantise_error": min_slice, "agg1_block_error": block_error, "agg2_packed_error": packed_error, "agg3_jn3_image_rms": image_pairs, "agg4_harness": harness, "src3_src5_generated": generated,
    "prj1_normalised": normalised, "prj2_tiles": tiles, "prj3_there_and_back": there_and_back, "prj4_prj8_flt1_sizes": sizes, "prj9_dec6_volume_blocks": volume_blocks, "flt7_updates": updates,
    "dec1_bc1_rgb": lambda spark, d: decode.bc1(fixtures.codes(spark, d, 8), False), "dec2_bc1_rgba": lambda spark, d: decode.bc1(fixtures.codes(spark, d, 8), True), "dec3_bc2": lambda spark, d: decode.bc2(fixtures.codes(spark, d, 16)),
    "dec4_bc3": lambda spark, d: decode.bc3(fixtures.codes(spark, d, 16)), "dec5_bc2_ordered": lambda spark, d: decode.bc2(fixtures.codes(spark, d, 16), True), "dec7_etc1": lambda spark, d: decode.etc1(fixtures.codes(spark, d, 8)),
    "dec8_dec11_fxt1": lambda spark, d: decode.fxt1(fixtures.codes(spark, d, 16)), "dec12_paletted": paletted, "dec6_volumes": volumes, "prj8_volume_sizes": volume_sizes,
}
ERR = f"WITH {QTEX}, er AS (SELECT label, vec_id, CAST(sum({SQ}) AS DOUBLE) / 16 AS error FROM qt GROUP BY label, vec_id)"
SQL = {
    "min_slice_quantise_error": f"{ERR} SELECT label, count(*) AS n_blocks, avg(error) AS mse, sqrt(avg(error)) AS rms FROM er GROUP BY label",
    "agg1_block_error": f"{ERR} SELECT vec_id, error FROM er",
    "agg4_harness": f"{ERR} SELECT label, sqrt(min(error)) AS least, sqrt(max(error)) AS most, sqrt(avg(error)) AS rms FROM er GROUP BY label",
    "agg2_packed_error": f"WITH {QTEX}, p AS (SELECT vec_id, 4278190080 | (r << 16) | (r << 8) | r AS p, r_q, g_q, b_q FROM qt), u AS (SELECT *, p & 255 AS r, (p >> 8) & 255 AS g, (p >> 16) & 255 AS b FROM p) SELECT vec_id, min(p) AS least_pixel, CAST(sum({SQ}) AS DOUBLE) / 16 AS error FROM u GROUP BY vec_id",
    "agg3_jn3_image_rms": f"WITH {PIX}, o AS (SELECT image, x, y, {_q('v', 5)} AS w FROM pix) SELECT image, count(*) AS pixels, sqrt(CAST(sum((v - w) * (v - w)) AS DOUBLE) / count(*)) AS rms FROM pix JOIN o USING (image, x, y) GROUP BY image",
    "src3_src5_generated": GENERATED_SQL,
    "prj1_normalised": f"WITH {fixtures.SQL_TEXELS}, n AS (SELECT *, vec_id % 4 + 1 AS channels FROM tex) SELECT vec_id, texel, channels, r, CASE WHEN channels <= 2 THEN r ELSE g END AS g, CASE WHEN channels <= 2 THEN r ELSE b END AS b, CASE WHEN channels = 2 THEN g WHEN channels = 4 THEN a ELSE 255 END AS a FROM n",
    "prj2_tiles": f"WITH {PIX} SELECT image, y // 4 AS block_y, x // 4 AS block_x, string_agg(CAST(v AS VARCHAR), ',' ORDER BY 4 * (y % 4) + x % 4) AS texels FROM pix GROUP BY image, y // 4, x // 4",
    "prj3_there_and_back": f"WITH {PIX} SELECT * FROM pix",
    "prj4_prj8_flt1_sizes": SIZES_SQL,
    "prj9_dec6_volume_blocks": VOLUME_SQL,
    "flt7_updates": "SELECT x, y, w, h, x % 4 = 0 AND y % 4 = 0 AND (w % 4 = 0 OR x + w = 10) AND (h % 4 = 0 OR y + h = 10) AS legal FROM range(10) s(x), range(10) t(y), range(1, 11) u(w), range(1, 11) v(h) WHERE x + w <= 10 AND y + h <= 10",
    "dec1_bc1_rgb": sql_decode(8, [*sql_colours(0, ""), "255"]),
    "dec2_bc1_rgba": sql_decode(8, [*sql_colours(0, ""), f"CASE WHEN {little(0, 2)} <= {little(2, 2)} AND {two_bits(4)} = 3 THEN 0 ELSE 255 END"]),
    "dec3_bc2": sql_decode(16, [*sql_colours(8, "true"), BC2_ALPHA]),
    "dec4_bc3": sql_decode(16, [*sql_colours(8, "true"), BC3_ALPHA]),
    "dec5_bc2_ordered": sql_decode(16, [*sql_colours(8, ""), BC2_ALPHA]),
    "dec7_etc1": etc1_sql(),
    "dec8_dec11_fxt1": fxt1_sql(),
    "dec12_paletted": paletted_sql(),
    "dec6_volumes": volumes_sql(),
    "prj8_volume_sizes": "SELECT w, h, d, ((w + 3) // 4) * ((h + 3) // 4) * d * 8 AS vtc_8, ((w + 3) // 4) * ((h + 3) // 4) * d * 16 AS vtc_16 FROM range(1, 20) s(w), range(1, 20) t(h), range(1, 10) u(d)",
}
