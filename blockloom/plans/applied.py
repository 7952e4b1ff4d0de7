"""Scalars, codebooks, partitions and sizes as they are used: over events, line items, embeddings, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.functions import halves
from blockloom.operators import census, decode, encode, errors, layout, lookups, nearest, partitions
from blockloom.plans.census import CHANNELS, MEM, _anchors, _book, channel_blocks
from blockloom.plans.encoding import _box
from blockloom.plans.fits import LINE_PIXELS, line_pixels
from blockloom.plans.scalars import CODER_SQL, _sql_half, _sql_spread
from blockloom.sources import fixtures


def event_halves(spark, d):
    """Values of events, and what they differ from 100 by, as halves and back: what truncation leaves."""
    v = F.col("value")
    each = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", halves.encode(v, False).alias("h"), halves.encode(v - 100, True).alias("signed_h"), "value")
    return each.select("event_id", "h", "signed_h", halves.decode(F.col("h"), False).alias("back"), halves.decode(F.col("signed_h"), True).alias("signed_back"))


def _sql_encode(x: str, m: int) -> str:
    size = f"abs({x})" if m == 10 else f"greatest({x}, 0)"
    e = f"len(list_filter(range(-14, 16), lambda k: {size} >= pow(2.0::DOUBLE, k)))"
    low = f"CASE WHEN {e} = 0 THEN CAST(floor({size} * pow(2.0::DOUBLE, {14 + m})) AS BIGINT) ELSE {e} * {1 << m} + CAST(floor(({size} / pow(2.0::DOUBLE, {e} - 15) - 1) * {1 << m}) AS BIGINT) END"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {low}{f' + CASE WHEN {x} < 0 THEN 32768 ELSE 0 END' if m == 10 else ''} END"


def channel_counts(spark, d):
    """(l_suppkey, channel, v, n): how often each supplier's pixels have each value; at most 768 rows a supplier."""
    each = line_pixels(spark, d).select("l_suppkey", F.posexplode(F.array(*"rgb")).alias("channel", "v"))
    return each.groupBy("l_suppkey", F.col("channel").cast("long").alias("channel"), "v").agg(F.count("*").alias("n"))


def line_channels(spark, d):
    """Each supplier's channels through quantisers of 4 to 8 bits: sums of the truncated value, the nearest level, its value with
    the lowest bit free, cleared and set, its expansion, odd quarters, and linear light in billionths."""
    v, level = F.col("v"), F.col("level")
    low = lambda k: F.shiftleft(F.shiftright(level, 1), 1).bitwiseOR(F.lit(k).cast("long"))
    counts, out, names = channel_counts(spark, d), None, ()
    for w in range(4, 9):
        made = {
            "truncated": ch.truncated(v, w), "nearest": level, "free": ch.spread(level, w), "cleared": ch.spread(low(0), w), "set": ch.spread(low(1), w),
            "ends": ch.endpoint(level, w), "ends_cleared": ch.endpoint(low(0), w), "ends_set": ch.endpoint(low(1), w), "odd": (F.pmod(F.floor(v / 4.0), F.lit(2)) == 1).cast("long"),
            "linear": F.round(ch.linear(v) * 1e9).cast("long"), "linear_low_threshold": F.round(ch.linear(v, 0.004045) * 1e9).cast("long"),
        }
        some = counts.withColumn("level", ch.nearest(v, w)).select("l_suppkey", "channel", F.lit(w).cast("long").alias("width"), "n", *[x.alias(n) for n, x in made.items()])
        out, names = some if out is None else out.unionByName(some), list(made)
    return out.groupBy("l_suppkey", "channel", "width").agg(F.sum("n").alias("pixels"), *[F.sum(F.col(n) * F.col("n")).alias(n) for n in names])


def _sql_channels() -> str:
    light = lambda t: f"CAST(round(CASE WHEN v / 255.0::DOUBLE <= {t}::DOUBLE THEN v / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((v / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END * 1e9::DOUBLE) AS BIGINT)"
    end = lambda x: f"((({x}) * (1 << width) + ({x})) >> (2 * width - 8))"
    clear, put = "((level >> 1) << 1)", "(((level >> 1) << 1) | 1)"
    made = {"truncated": _sql_spread("v >> (8 - width)", "width"), "nearest": "level", "free": _sql_spread("level", "width"), "cleared": _sql_spread(clear, "width"), "set": _sql_spread(put, "width"), "ends": end("level"), "ends_cleared": end(clear), "ends_set": end(put), "odd": "((v // 4) % 2)", "linear": light("0.04045"), "linear_low_threshold": light("0.004045")}
    return f"""WITH {LINE_PIXELS}, cc AS (SELECT l_suppkey, unnest([0, 1, 2]::BIGINT[]) AS channel, unnest([r, g, b]) AS v FROM px), wl AS (SELECT *, CAST(floor(v / 255.0::DOUBLE * ((1 << width) - 1) + 0.5::DOUBLE * (1 << (8 - width)) * ((1 << width) - 1) / 255.0::DOUBLE) AS BIGINT) AS level FROM cc, range(4, 9) s(width))
    SELECT l_suppkey, channel, width, count(*) AS pixels, {', '.join(f'CAST(sum({x}) AS BIGINT) AS "{n}"' for n, x in made.items())} FROM wl GROUP BY l_suppkey, channel, width"""


def line_residuals(spark, d):
    """14 bits of each line item's keys through the residual coder, by supplier: sums of the three codes and of what they give
    back, and the range of the rest after each stage."""
    i = F.pmod(F.col("l_orderkey") * 37 + F.col("l_partkey"), F.lit(1 << 14))
    out = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", i.alias("i"))
    rest = F.col("i")
    for c, (position, width) in STAGES.items():
        top, left = ch.code(rest, position, width, 8)
        out = out.withColumns({c: top, f"rest_{c}": left})
        rest = F.col(f"rest_{c}")
    back = [F.sum(ch.reconstruct(F.col(c), position, width, 8)).alias(f"back_{c}") for c, (position, width) in STAGES.items()]
    return out.groupBy("l_suppkey").agg(*[F.sum(c).alias(f"sum_{c}") for c in STAGES], *back, *[f(f"rest_{c}").alias(f"{n}_{c}") for c in STAGES for n, f in (("least", F.min), ("most", F.max))])


#: Position and width of the residual coder's stages.
STAGES = {"g": (14, 6), "b": (9, 5), "r": (5, 5)}


def event_divisions(spark, d):
    """Values of events less 127 over 5 and 7 by rounded-up reciprocals of 6 to 18 bits, by type: how many come out wrong,
    and what all are in total."""
    i = F.pmod(F.floor("value"), F.lit(255)) - 127
    counts = spark.read.parquet(f"{d}/events.parquet").where("value is not null").groupBy("event_type", i.alias("i")).agg(F.count("*").alias("n"))
    longs = lambda some: F.array(*[F.lit(x).cast("long") for x in some])
    each = counts.withColumn("divisor", F.explode(longs((5, 7)))).withColumn("shift", F.explode(longs(range(6, 19))))
    m = F.floor(F.pow(F.lit(2.0), F.col("shift")) / F.col("divisor")) + 1
    found = F.floor(F.col("i") * m / F.pow(F.lit(2.0), F.col("shift"))) + F.when(F.col("i") < 0, 1).otherwise(0)
    want = F.when(F.col("i") < 0, -F.floor(-F.col("i") / F.col("divisor"))).otherwise(F.floor(F.col("i") / F.col("divisor")))
    each = each.select("event_type", "divisor", "shift", "n", found.alias("found"), want.alias("want"))
    return each.groupBy("event_type", "divisor", "shift").agg(F.sum(F.when(F.col("found") != F.col("want"), F.col("n")).otherwise(0)).alias("wrong"), F.sum(F.col("found") * F.col("n")).alias("total"))


def heads(rows, key):
    """(vec_id, c): the first four bytes of each whole eight of the texts, as numbers; no others are looked at."""
    return fixtures.text_blocks(rows, key, "text", 8).select("vec_id", fixtures.numbers(F.col("c"), 4).alias("c"))


def document_levels(spark, d):
    """Two bytes at the head of each eight of a document as ends: levels of five and seven steps, and of palettes of 1 to 4
    index bits, each times its place, summed up by document."""
    s, e = F.col("c")[0], F.col("c")[1]
    sums = {f"steps_{k}": sum(ch.between(s, e, k, f) * f for f in range(1, k)) for k in (5, 7)}
    sums |= {f"index_{n}": sum(ch.weighted(s, e, w) * (i + 1) for i, w in enumerate(some)) for n, some in ch.WEIGHTS.items()}
    each = heads(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    return each.groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("blocks"), *[F.sum(x).alias(n) for n, x in sums.items()])


def _sql_levels() -> str:
    s, e = "c[1]", "c[2]"
    sums = {f"steps_{k}": " + ".join(f"((({k} - {f}) * {s} + {f} * {e}) // {k}) * {f}" for f in range(1, k)) for k in (5, 7)}
    weight = lambda n, i: f"((64 * {i} + {((1 << n) - 1) // 2}) // {(1 << n) - 1})"
    sums |= {f"index_{n}": " + ".join(f"(({s} * (64 - {weight(n, i)}) + {e} * {weight(n, i)}) >> 6) * {i + 1}" for i in range(1 << n)) for n in range(1, 5)}
    return f"WITH {fixtures.sql_text_codes('documents', 'doc_id', 'text', 8)} SELECT vec_id AS doc_id, count(*) AS blocks, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {n}' for n, x in sums.items())} FROM cod GROUP BY vec_id"


def embedding_directions(spark, d):
    """Each three neighbouring numbers of an embedding, the third without its sign, as a direction: on the square pyramid, and
    z from x and y."""
    at = lambda k: F.element_at("embedding", (F.col("three") * 3 + k).cast("int")).cast("double")
    threes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.size("embedding") / 3) - 1))
    each = fixtures.embeddings(spark, d).where("size(embedding) >= 3").select("vec_id", "embedding", threes.alias("three")).select("vec_id", "three", at(1).alias("x"), at(2).alias("y"), F.abs(at(3)).alias("z"))
    n = F.greatest(F.abs("x"), F.abs("y")) + F.col("z")
    each = each.withColumn("n", n).where("n > 0").select("vec_id", "three", "x", "y", *[(F.col(c) / F.col("n")).alias(w) for c, w in zip("xyz", "uvw")])
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    return each.select("vec_id", "three", "u", "v", "w", F.when(square <= 1, F.sqrt(1 - square)).alias("normal_z"))


def document_ends(spark, d):
    """(source, s, e, n): the ends that the first two bytes of each eight of the documents are, in order; at most 32896 a source,
    counted in each task before they are shuffled."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.struct("source").alias("own"), "text")
    each = heads(rows, "own")
    return each.groupBy(F.col("vec_id.source").alias("source"), F.least(F.col("c")[0], F.col("c")[1]).alias("s"), F.greatest(F.col("c")[0], F.col("c")[1]).alias("e")).agg(F.count("*").alias("n"))


def book(k: int):
    return sum((F.shiftleft(ch.between(F.col("s"), F.col("e"), k, f), 8 * (f - 1)) for f in range(2, k)), ch.between(F.col("s"), F.col("e"), k, 1))


def document_books(spark, d):
    """Distinct codebooks that the documents' ends make, by source: of five steps all and without mirrors, and of seven steps."""
    each = document_ends(spark, d).where("s >= 1 and e <= 254").withColumns({"five": book(5), "seven": book(7)})
    own = census.possible(F.col("s"), F.col("e"))
    return each.groupBy("source").agg(F.sum("n").alias("blocks"), F.count("*").alias("pairs"), F.count_distinct(F.when(own, F.col("five"))).alias("five"), F.count_distinct("five").alias("five_with_mirrors"), F.count_distinct("seven").alias("seven"))


def document_book_ends(spark, d):
    """Each codebook of seven steps that the documents make: how often, by which pairs of ends, the least and the greatest."""
    pairs = document_ends(spark, d).groupBy("s", "e").agg(F.sum("n").alias("n")).withColumn("book", book(7))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda p: F.concat_ws(":", p["s"].cast("string"), p["e"].cast("string")))
    return pairs.groupBy("book").agg(F.sum("n").alias("blocks"), F.array_join(listed, ",").alias("ends"), F.min(F.col("s") * 256 + F.col("e")).alias("least"), F.max(F.col("s") * 256 + F.col("e")).alias("most"))


def document_coverage(spark, d):
    """How many of 256 values each level of the documents' codebooks of five and seven steps takes, and how far the others are off
    the nearest lower one, or else the nearest higher one."""
    at = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(f).cast("long").alias("f")) for k in (5, 7) for f in range(k + 1)])).alias("at")
    key = (F.col("at.k") * 16 + F.col("at.f")).alias("key")
    made = F.floor(((F.col("at.k") - F.col("at.f")) * F.col("s") + F.col("at.f") * F.col("e")) / F.col("at.k"))
    hits = document_ends(spark, d).select("s", "e").distinct().select("s", "e", at).select(key, made.cast("double").alias("value")).distinct()
    values = spark.range(256).select(F.col("id").cast("double").alias("value"), at).select(key, "value")
    found = nearest.nearest_hits(values, hits, "key", "value", 4)
    hit = F.col("below") == F.col("value")
    far = F.when(hit, 0.0).otherwise(F.coalesce(F.col("value") - F.col("below"), F.col("above") - F.col("value"), F.lit(256.0)))
    return found.groupBy(F.floor(F.col("key") / 16).alias("steps"), F.pmod("key", F.lit(16)).alias("level")).agg(F.count_if(hit).alias("hits"), F.sqrt(F.sum(far * far) / 256).alias("rmse"))


def line_blocks(spark, d):
    """(kind, upper, lower, n): blocks that line items' pixels name, and how often: one channel alone, the whole colour, and two
    values of one channel, one for each half of the block."""
    px = line_pixels(spark, d)
    alone = lambda c, v: F.array(*[F.when(c == k, v).otherwise(0) for k in range(3)])
    one = px.select(F.posexplode(F.array(*"rgb")).alias("c", "v")).select(F.lit("one_channel").alias("kind"), alone(F.col("c"), F.col("v")).alias("upper")).withColumn("lower", F.col("upper"))
    whole = px.select(F.lit("one_colour").alias("kind"), F.array(*"rgb").alias("upper"), F.array(*"rgb").alias("lower"))
    c = F.pmod("l_linenumber", F.lit(3))
    two = px.select(F.lit("two_values").alias("kind"), alone(c, F.least("r", "g")).alias("upper"), alone(c, F.greatest("r", "g")).alias("lower"))
    return one.unionByName(whole).unionByName(two).groupBy("kind", "upper", "lower").agg(F.count("*").alias("n"))


def line_harness(spark, d):
    """Encodes and decodes these blocks: least, greatest and mean-square error by kind, as the harness sums up."""
    half = lambda c: F.concat(*[F.concat(F.col(c), F.array(F.lit(255).cast("long")))] * 8)
    each = line_blocks(spark, d).select(F.struct("kind", "upper", "lower", "n").alias("vec_id"), F.concat(half("upper"), half("lower")).alias("e"))
    back = decode.bc1(encode.range_fit(each, ["vec_id"]).withColumn("block", F.lit(0).cast("long")), False)
    own = F.when(F.col("texel") < 8, F.col("vec_id.upper")).otherwise(F.col("vec_id.lower"))
    found = back.withColumn("own", own).groupBy("vec_id").agg((F.sum(errors.squared(*[(F.element_at("own", k + 1), F.col(c)) for k, c in enumerate("rgb")])) / 16).alias("error"))
    n = F.col("vec_id.n")
    return found.groupBy("vec_id.kind").agg(F.sum(n).alias("blocks"), F.sqrt(F.min("error")).alias("least"), F.sqrt(F.max("error")).alias("most"), F.sqrt(F.sum(F.col("error") * n) / F.sum(n)).alias("rms"))


_pick = lambda v: ", ".join(f"CASE WHEN c = {k} THEN {v} ELSE 0 END" for k in range(3))
HARNESS_TEX = f"""{LINE_PIXELS}, gn AS (SELECT 'one_channel' AS label, [{_pick('v')}] AS up, [{_pick('v')}] AS lo FROM (SELECT unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM px) UNION ALL SELECT 'one_colour', [r, g, b], [r, g, b] FROM px
UNION ALL SELECT 'two_values', [{_pick('least(r, g)')}], [{_pick('greatest(r, g)')}] FROM (SELECT *, l_linenumber % 3 AS c FROM px)), ge AS MATERIALIZED (SELECT label, up, lo, count(*) AS n, row_number() OVER () AS vec_id FROM gn GROUP BY label, up, lo),
tex AS (SELECT vec_id, label, texel, {', '.join(f'CASE WHEN texel < 8 THEN up[{k}] ELSE lo[{k}] END AS {c}' for k, c in enumerate('rgb', 1))} FROM ge, range(16) s(texel))"""


def split_fits(spark, d):
    """Each channel of an embedding's block in three runs of its ordered values, at weights 1, a half and 0: the split whose
    least-squares ends leave least, by the sums of the split tables. A table's row holds all splits of n values, so that a
    block meets one row."""
    sums = lookups.fit_sums(spark).where("factor is not null").groupBy("n").agg(F.collect_list(F.struct("i", "j", "aa", "bb", "ab", "factor")).alias("splits"))
    own = channel_blocks(spark, d).select("vec_id", "channel", F.array_sort("values").alias("v"), F.size("values").cast("long").alias("n"))
    upto = F.transform(F.sequence(F.lit(0), F.size("v")), lambda k: F.aggregate(F.slice("v", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    own = own.select("vec_id", "channel", "n", upto.alias("upto")).join(F.broadcast(sums), "n")

    def fitted(x):
        p = lambda k: F.element_at("upto", (k + 1).cast("int"))
        middle = (p(x["j"]) - p(x["i"])) / 2
        first, last = p(x["i"]) + middle, p(F.col("n")) - p(x["j"]) + middle
        s, e = (first * x["bb"] - last * x["ab"]) * x["factor"], (last * x["aa"] - first * x["ab"]) * x["factor"]
        return F.struct((s * first + e * last).alias("gain"), (-x["i"]).alias("i"), (-x["j"]).alias("j"), s.alias("start"), e.alias("end"))

    best = own.select("vec_id", "channel", F.array_max(F.transform("splits", fitted)).alias("x"))
    return best.select("vec_id", "channel", (-F.col("x.i")).alias("i"), (-F.col("x.j")).alias("j"), "x.start", "x.end", "x.gain")


SPLIT_SQL = f"""WITH {fixtures.SQL_TEXELS}, o AS (SELECT vec_id, channel, list_sort(list(v)) AS v FROM ({CHANNELS}) GROUP BY vec_id, channel), u AS (SELECT vec_id, channel, list_transform(range(17), lambda k: coalesce(list_sum(v[1:k]), 0)::BIGINT) AS upto FROM o),
sm AS (SELECT i, j, i + (j - i) / 4.0::DOUBLE AS aa, 16 - j + (j - i) / 4.0::DOUBLE AS bb, (j - i) / 4.0::DOUBLE AS ab FROM range(16) s(i), range(17) t(j) WHERE j >= i AND NOT (i = 0 AND j = 0)), sf AS (SELECT *, 1 / (aa * bb - ab * ab) AS factor FROM sm WHERE abs(aa * bb - ab * ab) > 1e-9),
x AS (SELECT *, upto[i + 1] + (upto[j + 1] - upto[i + 1]) / 2.0::DOUBLE AS f, upto[17] - upto[j + 1] + (upto[j + 1] - upto[i + 1]) / 2.0::DOUBLE AS l FROM u, sf), y AS (SELECT *, (f * bb - l * ab) * factor AS st, (l * aa - f * ab) * factor AS en FROM x)
SELECT vec_id, channel, i, j, st AS start, en AS "end", gain FROM (SELECT *, st * f + en * l AS gain, row_number() OVER (PARTITION BY vec_id, channel ORDER BY st * f + en * l DESC, i, j) AS o FROM y) WHERE o = 1"""
ENDS_CTE = f"{fixtures.sql_text_codes('documents', 'source', 'text', 8)}, en AS (SELECT vec_id AS source, least(c[1], c[2]) AS s, greatest(c[1], c[2]) AS e, count(*) AS n FROM cod GROUP BY ALL)"


def swapped_blocks(spark, d):
    """Blocks of the embeddings' bytes with ends that change places: the codes that give the same texels, each times its place."""
    own = fixtures.codes(spark, d, 8)
    at = lambda k: F.col("c")[k]
    code = lambda t: ch.bits(at(4 + t // 4), 2 * (t % 4), 2)
    taken = lambda kind, x: F.element_at(F.array(*[F.lit(v).cast("long") for v in lookups.SWAPPED[kind]]), (x + 1).cast("int"))
    falls = at(0) + at(1) * 256 > at(2) + at(3) * 256
    colour = lambda t: F.when(falls, taken("four_colours", code(t))).otherwise(taken("three_colours", code(t)))
    alpha = lambda t: F.when(at(0) > at(1), taken("seven", F.pmod(at(2 + t), F.lit(8)))).otherwise(taken("five", F.pmod(at(2 + t), F.lit(8))))
    return own.select("vec_id", "block", falls.alias("four"), sum(colour(t) * (t + 1) for t in range(16)).alias("colours"), sum(alpha(t) * (t + 1) for t in range(6)).alias("alphas"))


def _sql_swapped() -> str:
    falls = "c[1] + c[2] * 256 > c[3] + c[4] * 256"
    colour = lambda t: f"(CASE WHEN q[{t + 1}] < 2 THEN 1 - q[{t + 1}] WHEN {falls} THEN 5 - q[{t + 1}] ELSE q[{t + 1}] END) * {t + 1}"
    alpha = lambda t: f"(CASE WHEN c[{t + 3}] % 8 < 2 THEN 1 - c[{t + 3}] % 8 WHEN c[1] > c[2] THEN 9 - c[{t + 3}] % 8 WHEN c[{t + 3}] % 8 < 6 THEN 7 - c[{t + 3}] % 8 ELSE c[{t + 3}] % 8 END) * {t + 1}"
    return f"WITH {fixtures.sql_codes(8)}, qs AS (SELECT *, list_transform(range(16), lambda t: (c[5 + t // 4] >> (2 * (t % 4))) & 3) AS q FROM cod) SELECT vec_id, block, {falls} AS four, {' + '.join(map(colour, range(16)))} AS colours, {' + '.join(map(alpha, range(6)))} AS alphas FROM qs"


def embedding_subsets(spark, d):
    """Each embedding's texels by the partition that its first two values name: texels and red by subset, red at the first
    texel and at the anchor, and red's words of four bytes under the subset's masks."""
    red = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.element_at("e", t * 4 + 1))
    rows = fixtures.blocks(spark, d).select("vec_id", red.alias("red"), (F.pmod(F.col("e")[0], F.lit(2)) + 2).alias("subsets"), F.pmod(F.col("e")[1], F.lit(64)).alias("partition"))
    masks = partitions.byte_masks(spark).groupBy("subsets", "partition", "subset").agg(F.map_from_entries(F.collect_list(F.struct("row", "mask"))).alias("masks"))
    known = partitions.first_texels(spark).join(partitions.anchors(spark), ["subsets", "partition", "subset"]).join(masks, ["subsets", "partition", "subset"])
    met = rows.join(F.broadcast(known), ["subsets", "partition"])
    word = lambda row: sum(F.shiftleft(F.col("red")[4 * row + k], 8 * k) for k in range(4))
    kept = [word(row).bitwiseAND(F.coalesce(F.col("masks")[F.lit(row).cast("long")], F.lit(0).cast("long"))) for row in range(4)]
    held = sum(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long")) for x in kept for k in range(4))
    at = lambda c: F.element_at("red", (F.col(c) + 1).cast("int"))
    return met.select("vec_id", "subsets", "partition", "subset", "texels", at("first").alias("first_red"), at("anchor").alias("anchor_red"), sum(kept).alias("masked"), held.alias("red"))


def page_sizes(spark, d):
    """Pages as images, as wide as their address and as high as their lines of 64 bytes: bytes in each format, as a volume of
    that many layers, where the block of the last texel lies, whether an update of what their id names is legal, and whether
    the size is that of the page before."""
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.octet_length("url").cast("long").alias("w"), F.ceil(F.octet_length("html") / 64).alias("h"), (F.pmod("page_id", F.lit(9)) + 1).alias("d"))
    w, h, z = F.col("w"), F.col("h"), F.col("d")
    x, y = F.pmod("page_id", w), F.pmod("page_id", h)
    before = rows.select((F.col("page_id") + 1).alias("page_id"), F.col("w").alias("w_before"), F.col("h").alias("h_before"))
    made = {**layout.sizes(w, h), "volume": layout.volume_size(w, h, z, 8), "last_block": layout.volume_block(w, h, z, w - 1, h - 1, z - 1, 8), "legal": layout.update_is_legal(x, y, w - x, F.least(h - y, F.lit(8).cast("long")), w, h)}
    return rows.where("w > 0 and h > 0").join(before, "page_id", "left").select("page_id", "w", "h", "d", *[c.alias(n) for n, c in made.items()], ((F.col("w_before") == w) & (F.col("h_before") == h)).alias("same"))



PAGES_SQL = """WITH p AS (SELECT page_id, strlen(url) AS w, CAST(ceil(strlen(html) / 64.0) AS BIGINT) AS h, page_id % 9 + 1 AS d FROM pages),
q AS (SELECT *, (w + 3) // 4 AS across, (h + 3) // 4 AS down, 4 * (d // 4) AS stacked, page_id % w AS x, page_id % h AS y, lag(w) OVER (ORDER BY page_id) AS w_before, lag(h) OVER (ORDER BY page_id) AS h_before FROM p WHERE w > 0 AND h > 0)
SELECT page_id, w, h, d, across * down * 8 AS s3tc_8, across * down * 16 AS s3tc_16, ((w + 7) // 8) * down * 16 AS fxt1, across * down * 8 AS atc_8, across * down * 16 AS atc_16, greatest(w, 8) * greatest(h, 8) * 4 // 8 AS pvrtc_4bpp, greatest(w, 16) * greatest(h, 8) * 2 // 8 AS pvrtc_2bpp, across * down * d * 8 AS volume,
CASE WHEN d - 1 >= stacked THEN 8 * (across * down * stacked + across - 1 + across * (down - 1 + down * (d - 1 - stacked))) ELSE 32 * (across - 1 + across * (down - 1 + down * ((d - 1) // 4))) END AS last_block,
x % 4 = 0 AND y % 4 = 0 AND (least(h - y, 8) % 4 = 0 OR y + least(h - y, 8) = h) AS legal, w = w_before AND h = h_before AS same FROM q"""

QUERIES = {
    "sc24_sc27_event_halves": event_halves, "sc5_sc10_line_channels": line_channels, "sc1_sc4_agg13_line_residuals": line_residuals, "sc11_event_divisions": event_divisions, "sc12_sc14_document_levels": document_levels,
    "src6_sc17_sc29_embedding_directions": embedding_directions, "agg5_agg6_flt5_document_books": document_books, "agg7_document_book_ends": document_book_ends, "jn10_swapped_blocks": swapped_blocks, "sc18_jn8_win1_win2_subsets": embedding_subsets, "prj4_prj8_prj9_flt1_flt4_pages": page_sizes,
    "agg12_jn7_document_coverage": document_coverage, "agg4_src3_src5_line_harness": line_harness, "agg15_split_fits": split_fits,
}
SQL = {
    "sc24_sc27_event_halves": f"WITH en AS (SELECT event_id, {_sql_encode('value', 11)} AS h, {_sql_encode('(value - 100)', 10)} AS signed_h FROM events) SELECT event_id, h, signed_h, back, signed_back FROM (SELECT *, {_sql_half('back', 11)}, {_sql_half('signed_back', 10).replace('(h ', '(signed_h ').replace('WHEN h ', 'WHEN signed_h ')} FROM en)",
    "sc5_sc10_line_channels": _sql_channels(),
    "sc1_sc4_agg13_line_residuals": f"WITH ln AS (SELECT l_suppkey, (l_orderkey * 37 + l_partkey) % 16384 AS i FROM lineitem), {CODER_SQL.replace('SELECT i, ', 'SELECT l_suppkey, i, ').replace('range(16384) s(i)', 'ln')} SELECT l_suppkey, "
    + ", ".join([*[f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in STAGES], *[f"CAST(sum({a} - rest_{c}) AS BIGINT) AS back_{c}" for c, a in (("g", "i"), ("b", "rest_g"), ("r", "rest_b"))], *[f"{f}(rest_{c}) AS {n}_{c}" for c in STAGES for n, f in (("least", "min"), ("most", "max"))]]) + " FROM c GROUP BY l_suppkey",
    "sc11_event_divisions": """WITH e AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 255 - 127 AS i FROM events WHERE value IS NOT NULL), a AS (SELECT *, CAST(floor(pow(2, shift) / divisor) AS BIGINT) + 1 AS m FROM e, range(5, 8, 2) s(divisor), range(6, 19) t(shift)),
    b AS (SELECT *, CAST(floor(i * m / pow(2, shift)) AS BIGINT) + CASE WHEN i < 0 THEN 1 ELSE 0 END AS found FROM a) SELECT event_type, divisor, shift, count(*) FILTER (found <> trunc(i / divisor)) AS wrong, CAST(sum(found) AS BIGINT) AS total FROM b GROUP BY event_type, divisor, shift""",
    "sc12_sc14_document_levels": _sql_levels(),
    "src6_sc17_sc29_embedding_directions": """WITH v AS (SELECT vec_id, three, CAST(embedding[3 * three + 1] AS DOUBLE) AS x, CAST(embedding[3 * three + 2] AS DOUBLE) AS y, abs(CAST(embedding[3 * three + 3] AS DOUBLE)) AS z FROM embeddings, range(21) t(three)), n AS (SELECT *, greatest(abs(x), abs(y)) + z AS n FROM v)
    SELECT vec_id, three, x / n AS u, y / n AS v, z / n AS w, CASE WHEN x * x + y * y <= 1 THEN sqrt(1 - (x * x + y * y)) END AS normal_z FROM n WHERE n > 0""",
    "agg5_agg6_flt5_document_books": f"WITH {ENDS_CTE}, bk AS (SELECT *, {_book(5)} AS five, {_book(7)} AS seven FROM en WHERE s >= 1 AND e <= 254) SELECT source, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS pairs, count(DISTINCT five) FILTER (254 - e >= s - 1) AS five, count(DISTINCT five) AS five_with_mirrors, count(DISTINCT seven) AS seven FROM bk GROUP BY source",
    "agg7_document_book_ends": f"WITH {ENDS_CTE}, pr AS (SELECT s, e, sum(n) AS n FROM en GROUP BY s, e), bk AS (SELECT *, {_book(7)} AS book FROM pr) SELECT book, CAST(sum(n) AS BIGINT) AS blocks, string_agg(s || ':' || e, ',' ORDER BY s, e) AS ends, min(s * 256 + e) AS least, max(s * 256 + e) AS most FROM bk GROUP BY book",
    "jn10_swapped_blocks": _sql_swapped(),
    "sc18_jn8_win1_win2_subsets": f"""WITH {MEM}, {fixtures.SQL_TEXELS}, anc AS ({_anchors}), hd AS (SELECT vec_id, e[1] % 2 + 2 AS subsets, e[2] % 64 AS partition FROM blk),
    m AS (SELECT vec_id, subsets, partition, subset, count(*) AS texels, arg_min(r, texel) AS first_red, CAST(sum(r << (8 * (texel % 4))) AS BIGINT) AS masked, CAST(sum(r) AS BIGINT) AS red FROM hd JOIN tex USING (vec_id) JOIN mem USING (subsets, partition, texel) GROUP BY vec_id, subsets, partition, subset)
    SELECT vec_id, subsets, partition, subset, texels, first_red, tex.r AS anchor_red, masked, red FROM m JOIN anc USING (subsets, partition, subset) JOIN tex USING (vec_id) WHERE tex.texel = anchor""",
    "prj4_prj8_prj9_flt1_flt4_pages": PAGES_SQL,
    "agg12_jn7_document_coverage": f"""WITH {ENDS_CTE}, lv AS (SELECT k, f FROM range(5, 8, 2) a(k), range(8) b(f) WHERE f <= k), hit AS (SELECT DISTINCT k, f, ((k - f) * s + f * e) // k AS h FROM en, lv),
    nr AS (SELECT k, f, v, max(h) FILTER (h <= v) AS below, min(h) FILTER (h >= v) AS above FROM lv CROSS JOIN range(256) t(v) LEFT JOIN hit USING (k, f) GROUP BY k, f, v)
    SELECT k AS steps, f AS level, count(*) FILTER (below = v) AS hits, sqrt(CAST(sum(CASE WHEN below = v THEN 0 ELSE coalesce(v - below, above - v, 256) * coalesce(v - below, above - v, 256) END) AS DOUBLE) / 256) AS rmse FROM nr GROUP BY k, f""",
    "agg4_src3_src5_line_harness": f"WITH {_box(HARNESS_TEX)}, er AS (SELECT vec_id, label, CAST(sum(err) AS DOUBLE) / 16 AS error FROM cod WHERE o = 1 GROUP BY vec_id, label) SELECT er.label AS kind, CAST(sum(n) AS BIGINT) AS blocks, sqrt(min(error)) AS least, sqrt(max(error)) AS most, sqrt(sum(error * n) / sum(n)) AS rms FROM er JOIN ge USING (vec_id) GROUP BY er.label",
    "agg15_split_fits": SPLIT_SQL,
}
