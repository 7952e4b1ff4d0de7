"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, scratch, set_aside, stored, with_row_index

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times the size of its source.
MOST = 3
#: The random offset of the systematic sample, drawn once.
OFFSET = 0.6180339887498949


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds each source's target to a table of (source, source_size).

    Resharing the excess until no target is above its cap ends at min(cap, level * weight) with one level for all.
    Sources that stop at their cap come first by cap / weight, so the level is found from running sums in that order.
    The table has a row per source, so its windows are small whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(all_of)).withColumn("weights", F.sum("weight").over(all_of))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shared = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("left", left).withColumn("shared", shared)
    #: Capped while an even share of what is left would pass the cap; whole numbers, so that no rounding decides.
    t = t.withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("shared"))
    free = F.max(F.when(~F.col("capped"), F.struct("shared", "left"))).over(all_of)
    t = t.withColumn("free", free)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free.left").cast("double") * F.col("weight") / F.col("free.shared"))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, offset: float = OFFSET) -> DataFrame:
    """Gives every document of (doc_id, text, source) its number of copies in the mix.

    Returns the carried columns with `_size`, `_source_size`, `_target` and `_copies`. A document's expected copies are its
    source's target over its source's size. Within a source documents stand by size, so that the words taken stay
    near the target, not only the documents; ties go by the hash of doc_id, then doc_id. Copies are the whole numbers
    that the running sum of expected copies, started at the offset, crosses at the document.

    Null text counts 0 words, null sources are one source, null and repeated ids are rows like others. An empty table
    gives an empty result; sources without words have target 0 and give no copy.
    """
    kept = docs.select(*[F.col(c) for c in carry], *[c for c in ("doc_id", "source") if c not in carry], words(F.col("text")).alias("_size"))
    place = ranked(kept.withColumn("_draw", F.md5(F.col("doc_id").cast("string").cast("binary"))), ["source"], [F.col("_size"), F.col("_draw"), F.col("doc_id")], "_place")
    goal = targets(place.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    goal = goal.select(*[F.col(c).alias(f"_{c}") for c in goal.columns])
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    both = place.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate)
    copies = F.floor(F.col("_place") * F.col("_rate") + offset) - F.floor((F.col("_place") - 1) * F.col("_rate") + offset)
    return both.select(*carry, "_size", "_source_size", "_target", copies.cast("long").alias("_copies"))


def op3_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    found = mix(docs, ["doc_id"])
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(3 * source_size) OVER w, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before
  FROM s WINDOW w AS (ORDER BY (3 * source_size) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, total - cap_before AS lft, weights - weight_before AS shared,
         (total - cap_before) * weight >= cap * (weights - weight_before) AS capped FROM r
), f AS (
  SELECT lft, shared FROM c WHERE NOT capped ORDER BY shared DESC, lft DESC LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE CAST((SELECT lft FROM f) AS DOUBLE) * weight / (SELECT shared FROM f) END AS target FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(place * rate + CAST(0.6180339887498949 AS DOUBLE)) - floor((place - 1) * rate + CAST(0.6180339887498949 AS DOUBLE)) AS BIGINT) * size AS taken
FROM p
"""


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with `copy` counting from 1.

    Where documents have a column of that name, the new one gets as many underscores as make it another.
    """
    rows = with_row_index(set_aside(docs, "doc_id", "source", "text"), "_row")
    name = "copy"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    with scratch() as keep:
        taken = keep(stored(mix(rows.select("_row", "doc_id", "source", "text"), ["_row"]).where("_copies > 0").select("_row", "_copies"), "taken"))
    both = rows.join(taken.select(F.col("_row").alias("_of"), "_copies").hint("merge"), F.col("_row") == F.col("_of"))
    return both.select(*[c for c in rows.columns if c != "_row"], F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).toDF(*docs.columns, name)
