"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored
from .license_texts import TEMPLATES

#: Words of any English text: a passage that shares only these with a template is not looked at further, if that is safe.
COMMON = tuple("a all an and any are as at be but by can for from if in into is it its may no not of on one or other out shall that the their these this to was way with without you your".split())
WORDS = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: The same for the templates, which are ASCII.
PLAIN_WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Cosine from which a passage is a template; whole numbers stand for weights, so that sums are exact.
LEAST, UNIT = 0.75, 100
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"


#: What parts paragraphs, and sentences where a capital follows.
PARAGRAPH, BREAK, SENTENCE = r"\n[ \t\r]*\n[ \t\r\n]*", r"[ \t\r]*\n[ \t\r]*", r"([.!?])[ \t]+(\p{Lu})"


class Weights:
    """Inverse document frequencies over the templates, and the templates as sparse vectors.

    A word's weight is its idf times the binary digits of how often it occurs, which grow as a logarithm.
    """

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES) -> None:
        self.statements = [(name, Counter(re.findall(PLAIN_WORDS, s.lower()))) for name, some in sorted(templates.items()) for s in some]
        df = Counter(w for _, words in self.statements for w in words)
        n = len(self.statements)
        self.idf = {w: round(UNIT * (1 + math.log((1 + n) / (1 + k)))) for w, k in sorted(df.items())}
        self.rare = round(UNIT * (1 + math.log(1 + n)))
        self.vectors = [(name, {w: c.bit_length() * self.idf[w] for w, c in sorted(words.items())}) for name, words in self.statements]

    def anchors(self, least: float) -> list[str]:
        """Words of which any passage at least this close to a template has one.

        By Cauchy and Schwarz, the cosine with a template is no more than the share of the template's length that lies
        in the words that are shared. So words are taken, those first that help most and are not of any English text,
        until what is left of every template is shorter than that.
        """
        vectors = [v for _, v in self.vectors]
        need = [sum(x * x for x in v.values()) * (1 - (least * 0.999) ** 2) for v in vectors]
        anchors, words = [], {w for v in vectors for w in v}
        while any(n > 0 for n in need):
            help_ = {w: sum(min(1.0, v[w] ** 2 / n) for v, n in zip(vectors, need) if n > 0 and w in v) for w in words.difference(anchors)}
            best = min(help_, key=lambda w: (w in COMMON, -help_[w], w))
            anchors.append(best)
            need = [n - v.get(best, 0) ** 2 for v, n in zip(vectors, need)]
        return anchors


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORDS), F.lit(0))


def near_paragraphs(text: Column, weights: Weights, least: float) -> Column:
    """The paragraphs (paragraph, said) that have one of the words without which nothing is close to a template."""
    anchors = F.array(*[F.lit(w) for w in weights.anchors(least)])
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda x, i: F.struct(i.alias("paragraph"), x.alias("said"), F.arrays_overlap(words_of(x), anchors).alias("near")))
    return F.transform(F.filter(parts, lambda p: p["near"]), lambda p: F.struct(p["paragraph"].alias("paragraph"), p["said"].alias("said")))


def passages(said: Column) -> Column:
    """A paragraph as a whole, its lines, and its sentences across line breaks."""
    sentences = F.split(F.regexp_replace(F.regexp_replace(said, BREAK, " "), SENTENCE, "$1\x01$2"), "\x01")
    return F.array_distinct(F.concat(F.array(said), F.split(said, "\n"), sentences))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(words: Column) -> Column:
    """A map from each word to how often it occurs: the words in order, cut where another one begins."""
    runs = lambda s: bound(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))), lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p - 1), F.coalesce(F.get(at, k + 1), F.size(s) + 1) - p)))
    return F.when(F.size(words) > 0, F.map_from_entries(bound(F.array_sort(words), runs)))


def mostly_known(words: Column, weights: Weights, least: float) -> Column:
    """Whether enough of a passage's length lies in words of the templates; if not, its cosine with none can be this high.

    Words of no template count as if they occurred once, which is the least that they can weigh.
    """
    idf = F.create_map(*[F.lit(x) for pair in weights.idf.items() for x in pair])

    def enough(n: Column, known: Column) -> Column:
        own = F.transform(known, lambda w: F.length(F.bin(F.element_at(n, w).cast("long"))).cast("long") * F.element_at(idf, w))
        mass = F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x * x)
        others = (F.size(n) - F.size(known)) * float(weights.rare) ** 2
        return mass * (1 - least**2) >= others * (least**2 * 0.999)

    learned = F.array(*[F.lit(w) for w in weights.idf])
    return bound(counted(words), lambda n: bound(F.array_intersect(F.map_keys(n), learned), lambda known: enough(n, known)))


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of the templates' own, told apart by no more than ASCII words and numbers, to be broadcast."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    values = ", ".join("(" + ", ".join(f"CAST({x!r} AS {k})" for x, k in zip(r, kinds)) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def sparse(table: DataFrame, value: str) -> DataFrame:
    """A table with the columns words and numbers, parted by spaces, as a row for each word and number."""
    both = F.explode(F.arrays_zip(F.split("words", " ").alias("word"), F.split("numbers", " ").alias("number"))).alias("x")
    rest = [c for c in table.columns if c not in ("words", "numbers")]
    return F.broadcast(table.select(*rest, both).select(*rest, "x.word", F.col("x.number").cast("long").alias(value)))


def best_templates(near: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(_row, _own) of the rows (_row, _near) with a passage close to a template: struct(minus the cosine, paragraph, license).

    Earlier paragraphs and names come first among equals. Sparse vectors meet as rows: words of passages by words of
    templates, summed by passage and template. The templates' tables are as small as the templates are.
    """
    spark = near.sparkSession
    of = lambda v: (" ".join(v), " ".join(map(str, v.values())))
    idf = sparse(inline(spark, [of(weights.idf)], "words string, numbers string"), "idf")
    vectors = sparse(inline(spark, [(k, *of(v)) for k, (_, v) in enumerate(weights.vectors)], "k int, words string, numbers string"), "weight")
    norms = inline(spark, [(k, name, sum(x * x for x in v.values())) for k, (name, v) in enumerate(weights.vectors)], "k int, license string, size bigint")
    anchors = F.array(*[F.lit(w) for w in weights.anchors(least)])
    each = near.select("_row", F.explode("_near").alias("x")).select("_row", F.col("x.paragraph").alias("paragraph"), F.posexplode(F.transform(passages(F.col("x.said")), words_of)).alias("piece", "words"))
    each = each.where(F.arrays_overlap("words", anchors) & mostly_known(F.col("words"), weights, least))
    each = stored(each, "passages")  # few are left, and they are read three times
    passage = ["_row", "paragraph", "piece"]
    counts = each.select(*passage, F.explode("words").alias("word")).groupBy(*passage, "word").agg(F.count("*").alias("n")).join(idf, "word", "left")
    own = F.length(F.bin("n")).cast("long") * F.coalesce("idf", F.lit(weights.rare))
    counts = counts.select(*passage, "word", own.alias("own"))
    size = counts.groupBy(*passage).agg(F.sum(F.col("own") * F.col("own")).alias("length"))
    dots = counts.join(vectors, "word").groupBy(*passage, "k").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    cosine = F.col("dot") / F.sqrt(F.col("length").cast("double") * F.col("size").cast("double"))
    found = dots.join(size, passage).join(norms, "k").withColumn("minus", -cosine).where(F.col("minus") <= -least)
    return found.groupBy("_row").agg(F.min(F.struct("minus", "paragraph", "license")).alias("_own"))


def scan(files: DataFrame, path: Column, text: Column, carry: list[str], least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """The carried columns with path, license, score, paragraph, inherited, license_file.

    A file's licence is that of the template closest to one of its passages: the paragraphs of the whole text, their
    lines and sentences, and a licence file (LICENSE, COPYING and the like) as a whole. A file without one gets the
    licence of the nearest directory above it that holds a licence file; of several there, the closest template counts,
    then the first path. Neither gives null.

    A null or empty text has no licence; a null path lies in no directory. Texts of any length are looked at whole.
    Repeated rows are rows of their own. Of equally close templates the earliest paragraph counts, then the first name.
    An empty table gives an empty result; only the carried columns are kept.
    """
    weights = Weights(templates)
    holds_licence = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    near = near_paragraphs(text, weights, least)
    near = F.when(holds_licence & (F.size(near) > 0), F.concat(near, F.array(F.struct(F.lit(0).alias("paragraph"), text.alias("said"))))).otherwise(near)
    rows = files.select(*carry, path.alias("path"), near.alias("_near"), F.monotonically_increasing_id().alias("_row"))
    with scratch() as keep:
        rows = stored(rows.withColumn("_dir", F.regexp_extract(F.coalesce("path", F.lit("")), r"(?s)^(.*)/[^/]*$", 1)), "paragraphs")
        close = best_templates(rows.where(F.size("_near") > 0), weights, least).withColumnRenamed("_row", "_at")
        # the result reads these rows twice, and no passage any more
        own = keep(stored(rows.drop("_near").join(close, F.col("_row") == F.col("_at"), "left").drop("_at"), "own"))
    named = own.where(F.col("_own").isNotNull() & F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE))
    per_dir = named.groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct(F.col("_own.minus").alias("minus"), "path", F.col("_own.license").alias("license"))).alias("_held"))
    # each directory once, with itself and all directories above it
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("_above")))
    dirs = own.where(F.col("path").isNotNull()).groupBy("_dir").agg(F.count("*").alias("_n")).select(F.col("_dir").alias("_of"), F.explode(above).alias("a"))
    nearest = dirs.select("_of", "a.*").join(per_dir, "_above").groupBy("_of").agg(F.max_by("_held", "depth").alias("_held"))
    both = own.join(nearest, (F.col("_dir") == F.col("_of")) & F.col("path").isNotNull(), "left")
    has = F.col("_own").isNotNull()
    return both.select(
        *carry, "path", F.coalesce("_own.license", "_held.license").alias("license"), (-F.coalesce("_own.minus", "_held.minus")).alias("score"),
        F.col("_own.paragraph").alias("paragraph"), (~has & F.col("_held").isNotNull()).alias("inherited"), F.when(~has, F.col("_held.path")).alias("license_file"),
    )


def op6_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, score, paragraph, inherited, license_file.

    The table has no file names. A tree is made of it: documents lie at source/lang/thousand/doc_id, and one that names
    a licence in its text, by that very word, is a licence file of its folder (LICENSE-doc_id).
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    name = F.concat(F.when(F.col("text").rlike("(?i)licen[cs]e"), "LICENSE-").otherwise(""), number)
    folder = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("-"))
    return scan(docs, F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), folder, name), F.col("text"), ["doc_id"])


def oracle() -> str:
    """SQL for op6_licenses."""
    w = Weights()
    idf = ", ".join(f"('{k}', {v})" for k, v in w.idf.items())
    vectors = ", ".join(f"({k}, '{name}', '{x}', {y})" for k, (name, v) in enumerate(w.vectors) for x, y in v.items())
    return rf"""
WITH idf(word, idf) AS (VALUES {idf}), vec(k, license, word, weight) AS (VALUES {vectors}),
norm AS (SELECT k, sum(weight * weight) AS n FROM vec GROUP BY k),
d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_matches(text, '(?i)licen[cs]e'), false) AS names,
      concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), '-')) AS dir FROM documents),
a AS (SELECT r, names, text, string_split_regex(text, '{PARAGRAPH}') AS ps FROM d WHERE text IS NOT NULL),
p AS (SELECT r, unnest(range(len(ps))) AS paragraph, unnest(ps) AS s FROM a UNION ALL SELECT r, 0, text FROM a WHERE names),
g AS (SELECT r, paragraph, s, row_number() OVER () AS g FROM p WHERE regexp_matches(lower(s), '{"|".join(re.escape(x) for x in w.anchors(LEAST))}')),
h AS (SELECT r, paragraph, g, list_distinct(list_concat(list_concat([s], string_split(s, chr(10))), string_split(regexp_replace(regexp_replace(s, '{BREAK}', ' ', 'g'), '{SENTENCE}', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS ss FROM g),
l AS (SELECT r, paragraph, concat_ws('-', g, unnest(range(len(ss)))) AS piece, unnest(ss) AS s FROM h),
t AS (SELECT r, paragraph, piece, unnest(regexp_extract_all(lower(s), '{WORDS}')) AS word FROM l),
c AS (SELECT r, paragraph, piece, t.word, length(bin(count(*))) AS n, coalesce(max(idf), {w.rare}) AS idf FROM t LEFT JOIN idf USING (word) GROUP BY r, paragraph, piece, t.word),
m AS (SELECT piece, sum(n * idf * n * idf) AS m FROM c GROUP BY piece),
s AS (SELECT c.r, c.paragraph, c.piece, k, license, CAST(sum(c.n * c.idf * weight) AS DOUBLE) AS dot FROM c JOIN vec USING (word) GROUP BY c.r, c.paragraph, c.piece, k, license),
q AS (SELECT s.r, s.paragraph, s.license, s.dot / sqrt(CAST(m.m AS DOUBLE) * CAST(norm.n AS DOUBLE)) AS score FROM s JOIN m USING (piece) JOIN norm ON norm.k = s.k),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, paragraph, license) AS o FROM q WHERE score >= {LEAST}),
o AS (SELECT d.*, b.license, b.score, b.paragraph, concat_ws('/', dir, CASE WHEN names THEN 'LICENSE-' ELSE '' END || coalesce(CAST(doc_id AS VARCHAR), '-')) AS path FROM d LEFT JOIN b ON d.r = b.r AND b.o = 1),
f AS (SELECT dir, path, license, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) AS o FROM o WHERE names AND license IS NOT NULL)
SELECT o.doc_id, o.path, coalesce(o.license, f.license) AS license, coalesce(o.score, f.score) AS score, CAST(o.paragraph AS INTEGER) AS paragraph, o.license IS NULL AND f.license IS NOT NULL AS inherited, CASE WHEN o.license IS NULL THEN f.path END AS license_file
FROM o LEFT JOIN f ON o.dir = f.dir AND f.o = 1
"""
