"""Queries of fits by lookup over whole tables: palettes with shared bits, packed entries, nearest hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import lookups, nearest, palette_fit, single_colour
from blockloom.plans.tables import COLOUR_CTE, ENDS, LONGS, PALETTES, _best, _sides, palette_sql
from blockloom.sources import fixtures

SIDES = [f"{c}_{e}" for c in "rgba" for e in ("first", "last")]


def line_pixels(spark, d):
    """Line items as pixels: the low bytes of part, supplier and order, and the quantity as alpha."""
    own = lambda c: F.pmod(F.col(c), F.lit(256)).cast("long")
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", own("l_partkey").alias("r"), own("l_suppkey").alias("g"), own("l_orderkey").alias("b"), F.floor(F.col("l_quantity") * 5).cast("long").alias("a"))


LINE_PIXELS = "px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b, CAST(floor(l_quantity * 5) AS BIGINT) AS a FROM lineitem)"


def embedding_fits(spark, d):
    """Each texel of the embeddings by the palette that comes nearest to it; of equal ones the first by name."""
    found = palette_fit.fit_pixels(fixtures.texels(spark, d), ["vec_id", "texel"], PALETTES)
    rest = ["case", "idx", *SIDES]
    picked = found.groupBy("vec_id", "texel").agg(F.min(F.struct("error", "palette", *rest)).alias("x"))
    return picked.select("vec_id", "texel", *[F.col(f"x.{c}").alias(c) for c in ("palette", "error", *rest)])


def line_fits(spark, d):
    """All pixels of the line items by each palette, summed up by supplier: errors, and how cases and indices are taken."""
    found = palette_fit.fit_pixels(line_pixels(spark, d), ["l_suppkey"], PALETTES)
    return found.groupBy("l_suppkey", "palette").agg(
        F.count("*").alias("pixels"), F.sum("error").alias("error"), F.max("error").alias("worst"), F.sum(F.col("case") * 8 + F.col("idx")).alias("taken"),
        F.sum(sum((k + 1) * F.col(s) for k, s in enumerate(SIDES))).alias("ends"),
    )


def _fits(pixels: str) -> str:
    """CTEs lut (all palettes) and fit: the best candidate of each distinct pixel by each palette."""
    luts = " UNION ALL ".join(f"SELECT '{n}' AS palette, * FROM ({palette_sql(n)})" for n in PALETTES)
    ends = ", ".join(f"l{c}.{e} AS {c}_{e}" for c in "rgba" for e in ("first", "last"))
    error = " + ".join(f"l{c}.err * l{c}.err" for c in "rgba")
    joins = " ".join(f"JOIN lut l{c} ON l{c}.value = p.{c}" + ("" if c == "r" else f' AND l{c}.palette = lr.palette AND l{c}."case" = lr."case" AND l{c}.idx = lr.idx') for c in "rgba")
    return f"""lut AS MATERIALIZED ({luts}), can AS (SELECT p.r, p.g, p.b, p.a, lr.palette, lr."case", lr.idx, {ends}, {error} AS error FROM (SELECT DISTINCT r, g, b, a FROM {pixels}) p {joins}),
    fit AS (SELECT DISTINCT ON (r, g, b, a, palette) * FROM can ORDER BY r, g, b, a, palette, error, "case", idx)"""


def packed_texels(spark, d):
    """All texels of the embeddings as single colours, through packed entries."""
    return single_colour.best_packed(fixtures.texels(spark, d).select("vec_id", "texel", *"rgb"), lookups.colour_table(spark))


def packed_lines(spark, d):
    """All line items as single colours, through packed entries."""
    return single_colour.best_packed(line_pixels(spark, d).drop("a"), lookups.colour_table(spark))


def _packed(keys: str) -> str:
    return f"{_sides('one', 'p.r, p.g, p.b')}, {_best('r, g, b')} SELECT {keys}, r, g, b, {LONGS}, {', '.join(ENDS)}, error, CAST(side * 2 AS BIGINT) AS code FROM px JOIN (SELECT * FROM pick WHERE o = 1) USING (r, g, b)"


def event_neighbours(spark, d):
    """Each event's value between the nearest purchases of its user, in hundredths, and how far off the nearer one is."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).alias("cents"))
    return gaps(nearest.nearest_hits(rows, rows.where("event_type = 'purchase'"), "user_id", "cents")).select("event_id", "cents", "below", "above", "far")


def gaps(found):
    far = F.coalesce(F.least(F.col("cents") - F.col("below"), F.col("above") - F.col("cents")), F.lit(-1.0))
    return found.withColumn("far", far)


QUERIES = {"jn_palette_fit_embeddings": embedding_fits, "jn_palette_fit_lines": line_fits, "fit6_sc28_texels": packed_texels, "fit6_sc28_lines": packed_lines, "jn9_event_neighbours": event_neighbours}
SQL = {
    "jn_palette_fit_embeddings": f"""WITH {fixtures.SQL_TEXELS}, {_fits('tex')}, top AS (SELECT DISTINCT ON (r, g, b, a) * FROM fit ORDER BY r, g, b, a, error, palette)
    SELECT vec_id, texel, palette, "case", idx, error, {', '.join(SIDES)} FROM tex JOIN top USING (r, g, b, a)""",
    "jn_palette_fit_lines": f"""WITH {LINE_PIXELS}, {_fits('px')} SELECT l_suppkey, palette, count(*) AS pixels, CAST(sum(error) AS BIGINT) AS error, max(error) AS worst, CAST(sum("case" * 8 + idx) AS BIGINT) AS taken,
    CAST(sum({' + '.join(f'{k + 1} * {s}' for k, s in enumerate(SIDES))}) AS BIGINT) AS ends FROM px JOIN fit USING (r, g, b, a) GROUP BY l_suppkey, palette""",
    "fit6_sc28_texels": f"WITH {COLOUR_CTE}, {fixtures.SQL_TEXELS}, px AS (SELECT vec_id, texel, r, g, b FROM tex), one AS (SELECT DISTINCT r, g, b FROM px), {_packed('vec_id, texel')}",
    "fit6_sc28_lines": f"WITH {COLOUR_CTE}, {LINE_PIXELS}, one AS (SELECT DISTINCT r, g, b FROM px), {_packed('l_orderkey, l_linenumber, l_partkey, l_suppkey')}",
    "jn9_event_neighbours": """WITH ev AS (SELECT event_id, user_id, event_type, round(value * 100) AS cents FROM events), hit AS (SELECT DISTINCT user_id, cents AS h FROM ev WHERE event_type = 'purchase' AND cents IS NOT NULL),
    lo AS (SELECT e.event_id, max(h) AS below FROM ev e JOIN hit ON hit.user_id = e.user_id AND h <= cents GROUP BY e.event_id), hi AS (SELECT e.event_id, min(h) AS above FROM ev e JOIN hit ON hit.user_id = e.user_id AND h >= cents GROUP BY e.event_id)
    SELECT event_id, cents, below, above, coalesce(least(cents - below, above - cents), -1) AS far FROM ev LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id)""",
}
