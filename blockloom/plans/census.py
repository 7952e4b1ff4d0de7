"""Queries on partitions, codebooks, coverage and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import channels as ch
from blockloom.operators import census, lookups, partitions
from blockloom.operators.encode import channel
from blockloom.sources import fixtures

#: (name, endpoint bits, levels, weights in 64ths, shared lowest bit)
COVERED = [(f"plain_{b}_{n}", b, n, False, None) for b in (5, 6) for n in (3, 4)] + [(f"weighted_{b}_{n}_{s}", b, n, True, v) for b in (4, 5) for n in (4, 8, 16) for s, v in (("free", None), ("cleared", 0), ("set", 1))]


def coverage(spark, d):
    return census.coverage(spark, COVERED)


def coverage_sql() -> str:
    parts = []
    for name, b, n, w, s in COVERED:
        x = {None: "{}", 0: "({} & ~1::BIGINT)", 1: "({} | 1)"}[s]
        end = lambda c: f"((({x.format(c)}) * {1 << b} + ({x.format(c)})) >> {2 * b - 8})"
        if w:
            table = ", ".join(f"({i}, {a}, {z})" for i, (a, z) in enumerate(zip(ch.WEIGHTS[n.bit_length() - 1], ch.WEIGHTS[n.bit_length() - 1][::-1])))
            made, source = f"({end('st')} * a + {end('en')} * z) // 64", f"(VALUES {table}) q(level, a, z)"
        else:
            made, source = f"({end('st')} * level + {end('en')} * {n - 1} - {end('en')} * level) // {n - 1}", f"range({n}) q(level)"
        parts.append(f"SELECT DISTINCT '{name}' AS kind, level, {made} AS value FROM range({1 << b}) s(st), range({1 << b}) t(en), {source}")
    return f"""WITH hit AS ({" UNION ALL ".join(parts)}), lev AS (SELECT DISTINCT kind, level FROM hit),
    f AS (SELECT l.kind, l.level, v.value, h.value IS NOT NULL AS is_hit, max(h.value) OVER (PARTITION BY l.kind, l.level ORDER BY v.value) AS below, min(h.value) OVER (PARTITION BY l.kind, l.level ORDER BY v.value DESC) AS above FROM lev l CROSS JOIN range(256) v(value) LEFT JOIN hit h ON h.kind = l.kind AND h.level = l.level AND h.value = v.value),
    m AS (SELECT kind, level, is_hit, CASE WHEN is_hit THEN 0 ELSE coalesce(value - below, above - value, 256) END AS far FROM f)
    SELECT kind, CAST(level AS BIGINT) AS level, count(*) FILTER (is_hit) AS hits, sqrt(CAST(sum(far * far) AS DOUBLE) / 256) AS rmse FROM m GROUP BY kind, level"""


def counts(spark, d):
    """Distinct codebooks: of five steps, those that can be told from their mirror and all of them, and of seven steps."""
    five, seven = census.codebooks(spark, 5, 1, 254), census.codebooks(spark, 7, 0, 255)
    some = [("five", five.where(census.possible(F.col("s"), F.col("e")))), ("five_with_mirrors", five), ("seven", seven)]
    return lookups.union([b.groupBy().agg(F.count_distinct("book").alias("books"), F.count("*").alias("pairs")).withColumn("kind", F.lit(n)) for n, b in some]).select("kind", "books", "pairs")


def _book(k: int) -> str:
    return " + ".join(f"(((({k} - {f}) * s + {f} * e) // {k}) << {8 * (f - 1)})" for f in range(1, k))


def ends(spark, d):
    return census.ends_of_books(census.codebooks(spark, 7, 0, 255))


def channel_values(spark, d):
    return fixtures.texels(spark, d).select("vec_id", "texel", F.posexplode(F.array(*"rgba")).alias("channel", "v")).withColumn("channel", F.col("channel").cast("long"))


def channel_blocks(spark, d):
    """(vec_id, channel, values): the 16 values of each of the four channels."""
    each = fixtures.blocks(spark, d).select("vec_id", F.posexplode(F.array(*[channel(F.col("e"), k) for k in range(4)])).alias("channel", "values"))
    return each.withColumn("channel", F.col("channel").cast("long"))


CHANNEL = ["vec_id", "channel"]


def nearest_levels(spark, d):
    return census.nearest_level_error(channel_blocks(spark, d), CHANNEL)


def tangent(spark, d):
    return census.tangent_search(channel_blocks(spark, d), CHANNEL)


def best_splits(spark, d):
    return census.best_split(census.split_sums(channel_values(spark, d), CHANNEL, "v"), CHANNEL)


def _error(s: str, e: str) -> str:
    levels = ", ".join(f"((7 - {f}) * {s} + {f} * {e}) // 7" for f in range(8))
    return f"CAST(list_sum(list_transform(vs, lambda v: list_min(list_transform([{levels}], lambda m: (v - m) * (v - m))))) AS BIGINT)"


CHANNELS = " UNION ALL ".join(f"SELECT vec_id, texel, {k}::BIGINT AS channel, {c} AS v FROM tex" for k, c in enumerate("rgba"))


def best_parts_sql(parts: int) -> str:
    cuts = [f"c{k}" for k in range(1, parts)]
    at = ["0", *cuts, "16"]
    gain = " + ".join(f"CASE WHEN {b} > {a} THEN CAST((upto[{b} + 1] - upto[{a} + 1]) * (upto[{b} + 1] - upto[{a} + 1]) AS DOUBLE) / ({b} - {a}) ELSE 0 END" for a, b in zip(at, at[1:]))
    grids = ", ".join(f"range(17) s{k}({c})" for k, c in enumerate(cuts))
    rise = " AND ".join(["true", *[f"{a} <= {b}" for a, b in zip(cuts, cuts[1:])]])
    return f"""WITH {fixtures.SQL_TEXELS}, o AS (SELECT vec_id, channel, list_sort(list(v)) AS v FROM ({CHANNELS}) GROUP BY vec_id, channel), u AS (SELECT vec_id, channel, list_transform(range(17), lambda k: coalesce(list_sum(v[1:k]), 0)::BIGINT) AS upto FROM o),
    g AS (SELECT vec_id, channel, {', '.join(cuts)}, {gain} AS gain FROM u, {grids} WHERE {rise}) SELECT vec_id, channel, {', '.join(cuts)}, gain FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY gain DESC, {', '.join(cuts)}) AS o FROM g) WHERE o = 1"""


def tangent_sql() -> str:
    ctes = [f"{fixtures.SQL_TEXELS}", f"r0 AS (SELECT vec_id, channel, min(v) AS s, max(v) AS e, list(v) AS vs FROM ({CHANNELS}) GROUP BY vec_id, channel)", f"q0 AS (SELECT *, {_error('s', 'e')} AS error FROM r0)"]
    for k in range(1, 5):
        tries = " UNION ALL ".join(f"SELECT vec_id, channel, vs, 1 AS moved, greatest(s + {i} * ((e - s) >> {k + 2}), 0) AS s, least(e + {j} * ((e - s) >> {k + 2}), 255) AS e FROM q{k - 1}" for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1)))
        ctes.append(f"t{k} AS (SELECT vec_id, channel, vs, 0 AS moved, s, e FROM q{k - 1} UNION ALL SELECT * FROM ({tries}) WHERE s <= e)")
        ctes.append(f"u{k} AS (SELECT *, {_error('s', 'e')} AS error FROM t{k})")
        ctes.append(f"q{k} AS (SELECT vec_id, channel, s, e, vs, error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY error, moved, s, e) AS o FROM u{k}) WHERE o = 1)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, channel, s, e, error FROM q4"


_masks = " UNION ALL ".join(f"SELECT {n} AS subsets, unnest(range(64)) AS partition, unnest([{', '.join(map(str, some))}]::BIGINT[]) AS mask" for n, some in ((2, partitions.TWO), (3, partitions.THREE)))
MEM = f"msk AS ({_masks}), mem AS (SELECT CAST(subsets AS BIGINT) AS subsets, partition, texel, CASE WHEN subsets = 3 AND (mask >> (16 + texel)) & 1 = 1 THEN 2 ELSE (mask >> texel) & 1 END AS subset FROM msk, range(16) t(texel))"
_anchors = " UNION ALL ".join(f"SELECT {n}::BIGINT AS subsets, unnest(range(64)) AS partition, {s}::BIGINT AS subset, unnest([{', '.join(map(str, some))}]::BIGINT[]) AS anchor" for n, s, some in ((2, 1, partitions.ANCHORS_TWO), (3, 1, partitions.ANCHORS_THREE_1), (3, 2, partitions.ANCHORS_THREE_2), (2, 0, (0,) * 64), (3, 0, (0,) * 64)))


def anchored(spark, d):
    """Anchors, and whether each lies in its subset."""
    at = partitions.members(spark).select("subsets", "partition", F.col("texel").alias("anchor"), F.col("subset").alias("of"))
    return partitions.anchors(spark).join(at, ["subsets", "partition", "anchor"]).select("subsets", "partition", "subset", "anchor", (F.col("of") == F.col("subset")).alias("inside"))


def masked_error(spark, d):
    """Error to the subset's mean for each of the 64 two-subset partitions of each embedding, and the best of them: the mask says which texels count."""
    t = fixtures.texels(spark, d).join(F.broadcast(partitions.members(spark).where("subsets = 2")), "texel")
    sums = t.groupBy("vec_id", "partition", "subset").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in "rgb"], F.sum(sum(F.col(c) * F.col(c) for c in "rgb")).alias("q"))
    # 16-fold of nothing is lost: the error times n is a whole number
    error = F.col("q") - sum(F.col(f"s_{c}") * F.col(f"s_{c}") for c in "rgb") / F.col("n")
    per = sums.select("vec_id", "partition", "subset", error.alias("error")).groupBy("vec_id", "partition").agg((F.max(F.when(F.col("subset") == 0, F.col("error"))) + F.max(F.when(F.col("subset") == 1, F.col("error")))).alias("error"))
    return per.groupBy("vec_id").agg(F.min(F.struct("error", "partition")).alias("x")).select("vec_id", "x.partition", "x.error")


QUERIES = {
    "jn8_members": lambda spark, d: partitions.members(spark), "win1_first_texels": lambda spark, d: partitions.first_texels(spark), "win2_anchors": anchored, "sc18_byte_masks": lambda spark, d: partitions.byte_masks(spark), "flt6_best_partition": masked_error,
    "agg5_agg6_flt5_codebooks": counts, "agg7_ends_of_books": ends, "agg8_jn4_nearest_levels": nearest_levels, "sc16_agg11_tangent_search": tangent, "agg12_jn7_jn9_coverage": coverage, "win3_splits": lambda spark, d: census.split_sums(channel_values(spark, d), CHANNEL, "v"), "win3_best_split": best_splits,
    "win3_three_parts": lambda spark, d: census.best_parts(channel_blocks(spark, d), CHANNEL, 3), "win3_four_parts": lambda spark, d: census.best_parts(channel_blocks(spark, d), CHANNEL, 4), "agg7_end_sets": lambda spark, d: census.end_sets(census.codebooks(spark, 7, 0, 255)),
}
SPLITS = f"{fixtures.SQL_TEXELS}, spl AS (SELECT vec_id, channel, row_number() OVER w AS low_n, CAST(sum(v) OVER w AS BIGINT) AS low_sum, 16 - row_number() OVER w AS high_n, CAST(sum(v) OVER (PARTITION BY vec_id, channel) - sum(v) OVER w AS BIGINT) AS high_sum FROM ({CHANNELS}) WINDOW w AS (PARTITION BY vec_id, channel ORDER BY v, texel ROWS UNBOUNDED PRECEDING))"
SQL = {
    "jn8_members": f"WITH {MEM} SELECT * FROM mem",
    "win1_first_texels": f"WITH {MEM} SELECT subsets, partition, subset, min(texel) AS first, count(*) AS texels FROM mem GROUP BY subsets, partition, subset",
    "win2_anchors": f"WITH {MEM}, anc AS ({_anchors}) SELECT anc.*, mem.subset = anc.subset AS inside FROM anc JOIN mem ON mem.subsets = anc.subsets AND mem.partition = anc.partition AND mem.texel = anc.anchor",
    "sc18_byte_masks": f"WITH {MEM} SELECT subsets, partition, subset, texel // 4 AS row, CAST(sum(255::BIGINT << (8 * (texel % 4))) AS BIGINT) AS mask FROM mem GROUP BY subsets, partition, subset, texel // 4",
    "flt6_best_partition": f"""WITH {MEM}, {fixtures.SQL_TEXELS}, u AS (SELECT vec_id, partition, subset, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r + g * g + b * b) AS q FROM tex JOIN mem USING (texel) WHERE subsets = 2 GROUP BY vec_id, partition, subset),
    x AS (SELECT vec_id, partition, subset, CAST(q AS DOUBLE) - CAST(sr * sr + sg * sg + sb * sb AS DOUBLE) / n AS error FROM u), y AS (SELECT vec_id, partition, max(error) FILTER (subset = 0) + max(error) FILTER (subset = 1) AS error FROM x GROUP BY vec_id, partition)
    SELECT vec_id, partition, error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, partition) AS o FROM y) WHERE o = 1""",
    "agg5_agg6_flt5_codebooks": f"WITH f AS (SELECT s, e, {_book(5)} AS book FROM range(1, 255) a(s), range(1, 255) b(e) WHERE s <= e), v AS (SELECT s, e, {_book(7)} AS book FROM range(256) a(s), range(256) b(e) WHERE s <= e) SELECT 'five' AS kind, count(DISTINCT book) AS books, count(*) AS pairs FROM f WHERE 254 - e >= s - 1 UNION ALL SELECT 'five_with_mirrors', count(DISTINCT book), count(*) FROM f UNION ALL SELECT 'seven', count(DISTINCT book), count(*) FROM v",
    "agg7_ends_of_books": f"WITH v AS (SELECT s, e, {_book(7)} AS book FROM range(256) a(s), range(256) b(e) WHERE s <= e) SELECT book, count(*) AS pairs, min(s * 256 + e) // 256 AS least_s, min(s * 256 + e) % 256 AS least_e, max(s * 256 + e) // 256 AS most_s, max(s * 256 + e) % 256 AS most_e FROM v GROUP BY book",
    "agg8_jn4_nearest_levels": f"WITH {fixtures.SQL_TEXELS}, q AS (SELECT vec_id, channel, min(v) AS s, max(v) AS e, list(v) AS vs FROM ({CHANNELS}) GROUP BY vec_id, channel) SELECT vec_id, channel, s, e, {_error('s', 'e')} AS error FROM q",
    "win3_three_parts": best_parts_sql(3), "win3_four_parts": best_parts_sql(4),
    "agg7_end_sets": f"WITH v AS (SELECT s, e, {_book(7)} AS book FROM range(256) a(s), range(256) b(e) WHERE s <= e) SELECT book, string_agg(s || ':' || e, ',' ORDER BY s, e) AS ends FROM v GROUP BY book",
    "sc16_agg11_tangent_search": tangent_sql(),
    "agg12_jn7_jn9_coverage": coverage_sql(),
    "win3_splits": f"WITH {SPLITS} SELECT * FROM spl",
    "win3_best_split": f"WITH {SPLITS} SELECT vec_id, channel, low_n, low_sum, high_n, high_sum FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY -(CAST(low_sum * low_sum AS DOUBLE) / low_n + CASE WHEN high_n > 0 THEN CAST(high_sum * high_sum AS DOUBLE) / high_n ELSE 0 END), low_n) AS o FROM spl) WHERE o = 1",
}
