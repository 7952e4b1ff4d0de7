"""Queries on the least-squares fits: by clusters, over and over, weighted by alpha, and by partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import alpha, cluster, decode, encode
from blockloom.operators.encode import METRICS
from blockloom.plans.census import MEM
from blockloom.plans.tables import sql_replicate
from blockloom.sources import fixtures


def hex_bytes(c):
    return F.lower(F.hex(F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ""))))


def vectors(spark, d):
    return fixtures.blocks(spark, d).select("vec_id", "e")


def fit_query(**options):
    """BC1 bytes of the embeddings' blocks with their error."""

    def run(spark, d):
        return cluster.cluster_fit(vectors(spark, d), ["vec_id"], **options).select("vec_id", hex_bytes("c").alias("bytes"), "error")

    return run


def text_pixels(rows, key, text):
    """Whole texts as blocks of 16 RGBA pixels, 64 bytes each; what remains of a text is left out."""
    return fixtures.text_blocks(rows, key, text, 64).select(F.col("vec_id").alias(key), "block", F.col("c").alias("e"))


#: What tells byte strings apart: a sum of bytes by powers of 257.
DIGEST = 1_000_000_007


def documents(spark, d):
    """Each document's bytes as blocks of pixels: how many, their error by the cluster fit and by the box, and a sum over all bytes."""
    blocks = text_pixels(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    found = cluster.cluster_fit(blocks, ["doc_id", "block"])
    digest = sum(F.element_at("c", k + 1) * pow(257, k, DIGEST) for k in range(8))
    each = found.select("doc_id", "error", "box_error", F.pmod(F.pmod(digest, F.lit(DIGEST)) * (F.pmod("block", F.lit(1009)) + 1), F.lit(DIGEST)).alias("digest"))
    return each.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("error").alias("error"), F.sum("box_error").alias("box_error"), F.count_if(F.col("error") > F.col("box_error")).alias("worse"), F.sum("digest").alias("digest"))


def partitions_of(spark, d):
    return cluster.partition_fit(vectors(spark, d), ["vec_id"])


def round_trip(spark, d):
    """Each label's blocks encoded and decoded: the error of what a decoder gives, by the box and by clusters."""
    own = fixtures.blocks(spark, d).select("label", "vec_id", "e")
    each = [(n, encode.range_fit(own, ["label", "vec_id", "e"])) if n == "range" else (n, cluster.cluster_fit(own.withColumn("kept", F.col("e")), ["label", "vec_id", "kept"], iterate=n == "iterative").drop("error", "box_error").withColumnRenamed("kept", "e")) for n in ("range", "cluster", "iterative")]
    parts = []
    for name, found in each:
        coded = found.select(F.struct(F.lit(name).alias("fit"), "label", "e").alias("vec_id"), F.col("vec_id").alias("block"), "c")
        t = decode.bc1(coded, False)
        far = sum((F.element_at("vec_id.e", (F.col("texel") * 4 + k + 1).cast("int")) - F.col(c)) ** 2 for k, c in enumerate("rgb"))
        parts.append(t.select("vec_id.fit", "vec_id.label", far.cast("long").alias("far")))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("label", "fit").agg((F.count("*") / 16).cast("long").alias("blocks"), F.sum("far").alias("error"))


CHANNELS = "rgb"


def sql_order(name: str, source: str, axis: str, keys: str) -> str:
    """Prefix sums p_w, p_r, p_g, p_b of the texels of a source (keys, texel, r, g, b, w) in order along axis (keys, v0, v1, v2)."""
    lists = ", ".join(f"list_prepend(0, list({x} ORDER BY place)) AS p_{c}" for c, x in (("w", "cw"), *((c, f"c{c}") for c in CHANNELS)))
    over = "OVER (PARTITION BY {0} ORDER BY s.r * v0 + s.g * v1 + s.b * v2, s.texel ROWS UNBOUNDED PRECEDING)".format(", ".join(f"s.{k}" for k in keys.split(", ")))
    sums = ", ".join(f"CAST(sum({x}) {over} AS BIGINT) AS c{c}" for c, x in (("w", "s.w"), *((c, f"s.w * s.{c}") for c in CHANNELS)))
    return f"{name} AS (SELECT {keys}, any_value(sq) AS sq, {lists} FROM (SELECT {', '.join(f's.{k}' for k in keys.split(', '))}, a.sq, row_number() {over} AS place, {sums} FROM {source} s JOIN {axis} a USING ({keys})) GROUP BY {keys})"


def sql_axis(name: str, source: str, keys: str) -> str:
    """(keys, sq, v0, v1, v2): the principal axis by power iteration in whole numbers, and sq the sums of squares by channel."""
    pairs = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]
    sums = ", ".join(f"CAST(sum(w * {a} * {b}) AS BIGINT) AS q_{a}{b}" for a, b in pairs)
    own = f"{name}_s AS (SELECT {keys}, CAST(sum(w) AS BIGINT) AS n, {', '.join(f'CAST(sum(w * {c}) AS BIGINT) AS s_{c}' for c in CHANNELS)}, {sums} FROM {source} GROUP BY {keys})"
    cov = f"{name}_c AS (SELECT {keys}, [q_rr, q_gg, q_bb] AS sq, {', '.join(f'n * q_{a}{b} - s_{a} * s_{b} AS c_{a}{b}' for a, b in pairs)} FROM {name}_s)"
    rows = [("c_rr", "c_rg", "c_rb"), ("c_rg", "c_gg", "c_gb"), ("c_rb", "c_gb", "c_bb")]
    at = lambda k: f"CASE WHEN c_rr >= c_gg AND c_rr >= c_bb THEN {rows[0][k]} WHEN c_gg >= c_bb THEN {rows[1][k]} ELSE {rows[2][k]} END"
    ctes = [own, cov, f"{name}_u0 AS (SELECT *, {', '.join(f'{at(k)} AS u{k}' for k in range(3))} FROM {name}_c)"]
    for i in range(cluster.ROUNDS + 1):
        most = "greatest(abs(u0), abs(u1), abs(u2))"
        unit = ", ".join(f"CASE WHEN {most} = 0 THEN 0 ELSE CAST(floor(CAST(u{k} AS DOUBLE) * {cluster.UNIT} / CAST({most} AS DOUBLE)) AS BIGINT) END AS v{k}" for k in range(3))
        ctes.append(f"{name}_v{i} AS (SELECT * EXCLUDE (u0, u1, u2), {unit} FROM {name}_u{i})")
        ctes.append(f"{name}_u{i + 1} AS (SELECT * EXCLUDE (v0, v1, v2), {', '.join(' + '.join(f'{rows[k][j]} * v{j}' for j in range(3)) + f' AS u{k}' for k in range(3))} FROM {name}_v{i})")
    return ", ".join(ctes[:-1]) + f", {name} AS (SELECT {keys}, sq, v0, v1, v2 FROM {name}_v{cluster.ROUNDS})"


def sql_split(name: str, order: str, keys: str, levels: tuple[int, ...], bits: tuple[int, ...], metric: tuple[int, ...]) -> str:
    """(keys, error, e0_r, … e1_b): the best split's error and its ends; no row where no split has an answer."""
    whole, cuts = levels[0], [f"k{i}" for i in range(1, len(levels))]
    at = ["0", *cuts, "(len(p_w) - 1)"]
    run = lambda c: [f"(p_{c}[{b} + 1] - p_{c}[{a} + 1])" for a, b in zip(at, at[1:])]
    share = lambda c, f: " + ".join(f"{f(x)} * {r}" for x, r in zip(levels, run(c)) if f(x)) or "0"
    rise = " AND ".join(f"{a} <= {b}" for a, b in zip(at[1:], at[2:]))
    grid = ", ".join(f"range(17) s_{c}({c})" for c in cuts)
    sums = f"{share('w', lambda x: x * x)} AS waa, {share('w', lambda x: (whole - x) ** 2)} AS wbb, {share('w', lambda x: x * (whole - x))} AS wab"
    sums += "".join(f", {share(c, lambda x: x)} AS a{c}, {share(c, lambda x: whole - x)} AS b{c}" for c in CHANNELS)
    end = lambda n, top: f"least({top}, (2 * {top * whole} * greatest({n}, 0) + 255 * det) // (510 * det))"
    ends = ", ".join(f"{end(f'(a{c} * wbb - b{c} * wab)', (1 << w) - 1)} AS e0_{c}, {end(f'(b{c} * waa - a{c} * wab)', (1 << w) - 1)} AS e1_{c}" for c, w in zip(CHANNELS, bits))
    wide = lambda x, w: x if w == 8 else sql_replicate(x, w)
    full = ", ".join(f"{wide(f'e{e}_{c}', w)} AS f{e}_{c}" for c, w in zip(CHANNELS, bits) for e in (0, 1))
    error = " + ".join(f"{m} * (waa * f0_{c} * f0_{c} + wbb * f1_{c} * f1_{c} + 2 * wab * f0_{c} * f1_{c} - {2 * whole} * (a{c} * f0_{c} + b{c} * f1_{c}) + {whole * whole} * sq[{k + 1}])" for k, (c, m) in enumerate(zip(CHANNELS, metric)))
    names = ", ".join(f"e{e}_{c}" for e in (0, 1) for c in CHANNELS)
    cut = " + ".join(f"{c} * {17 ** (len(cuts) - i)}" for i, c in enumerate(cuts, 1))
    return f"""{name} AS (SELECT {keys}, x.error AS error, {', '.join(f'x.{n} AS {n}' for n in names.split(', '))} FROM (
        SELECT {keys}, arg_min({{'error': error, {', '.join(f"'{n}': {n}" for n in names.split(', '))}}}, error::HUGEINT * {17 ** len(cuts) * 17} + cut) AS x FROM (
        SELECT {keys}, cut, {names}, {error} AS error FROM (SELECT *, {full} FROM (SELECT *, {ends} FROM (SELECT *, waa * wbb - wab * wab AS det FROM (SELECT {keys}, sq, {cut} AS cut, {sums} FROM {order}, {grid} WHERE {rise}) ) WHERE det > 0))) GROUP BY {keys}))"""


def _word(e: int) -> str:
    return f"(e{e}_r << 11) + (e{e}_g << 5) + e{e}_b"


def sql_coded(name: str, source: str, kinds: list[tuple[str, bool]], keys: str, metric: tuple[int, ...]) -> str:
    """(keys, error, bytes): the best of some kinds of ends on what a decoder makes of them; earlier kinds among equals."""
    parts = [f"SELECT {keys}, {i} AS kind, {four} AS four, {'greatest' if four else 'least'}({_word(0)}, {_word(1)}) AS c0, {'least' if four else 'greatest'}({_word(0)}, {_word(1)}) AS c1 FROM {k}" for i, (k, four) in enumerate(kinds)]
    field = lambda c, x: {"r": sql_replicate(f"({x} >> 11)", 5), "g": sql_replicate(f"(({x} >> 5) & 63)", 6), "b": sql_replicate(f"({x} & 31)", 5)}[c]
    p = {c: (field(c, "c0"), field(c, "c1")) for c in CHANNELS}
    level = lambda c: f"CASE code WHEN 0 THEN {p[c][0]} WHEN 1 THEN {p[c][1]} WHEN 2 THEN CASE WHEN four THEN (2 * {p[c][0]} + {p[c][1]}) // 3 ELSE ({p[c][0]} + {p[c][1]}) // 2 END ELSE ({p[c][0]} + 2 * {p[c][1]}) // 3 END"
    far = " + ".join(f"{m} * (s.{c} - l.l_{c}) * (s.{c} - l.l_{c})" for c, m in zip(CHANNELS, metric))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""{name}_k AS ({' UNION ALL '.join(parts)}), {name}_l AS (SELECT {keys}, kind, c0, c1, code, {', '.join(f'{level(c)} AS l_{c}' for c in CHANNELS)} FROM {name}_k, range(4) q(code) WHERE four OR code < 3),
    {name}_t AS (SELECT {own}, kind, c0, c1, s.texel, min(({far}) * 4 + code) AS m, any_value(s.w) AS w FROM {source} s JOIN {name}_l l USING ({keys}) GROUP BY {own}, kind, c0, c1, s.texel),
    {name}_r AS (SELECT {keys}, kind, c0, c1, texel // 4 AS row, CAST(sum((m % 4) << (2 * (texel % 4))) AS BIGINT) AS code, CAST(sum(m // 4 * w) AS BIGINT) AS error FROM {name}_t GROUP BY {keys}, kind, c0, c1, texel // 4),
    {name}_b AS (SELECT {keys}, kind, CAST(sum(error) AS BIGINT) AS error, [c0 & 255, c0 >> 8, c1 & 255, c1 >> 8] || list(code ORDER BY row) AS c FROM {name}_r GROUP BY {keys}, kind, c0, c1),
    {name} AS (SELECT {keys}, error, c FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY error, kind) AS o FROM {name}_b) WHERE o = 1)"""


def sql_box(name: str, source: str, keys: str) -> str:
    ends = ", ".join(f"{f}({c}) >> {8 - w} AS e{e}_{c}" for c, w in encode.WIDTHS for e, f in enumerate(("max", "min")))
    return f"{name} AS (SELECT {keys}, {ends} FROM {source} GROUP BY {keys})"


def sql_fit(source: str, keys: str, metric: str = "uniform", three: bool = True, rounds: int = 0) -> str:
    """CTEs up to `best` (keys, error, c) for a source (keys, texel, r, g, b, w)."""
    m, bits = METRICS[metric], cluster.COLOUR_BITS
    kinds = [("four", cluster.THIRDS, True), *([("three", cluster.HALVES, False)] if three else [])]
    ctes = [sql_axis("ax", source, keys), sql_order("ord", source, "ax", keys)]
    for name, levels, _ in kinds:
        ctes.append(sql_split(f"{name}_0", "ord", keys, levels, bits, m))
        for r in range(rounds):
            # blocks whose error fell go on along the line between their ends
            fell = f"{name}_{r}" if not r else f"(SELECT * FROM {name}_{r} WHERE fell)"
            wide = ", ".join(f"{sql_replicate(f'e0_{c}', w)} - {sql_replicate(f'e1_{c}', w)} AS v{k}" for k, (c, w) in enumerate(encode.WIDTHS))
            ctes.append(f"{name}_a{r} AS (SELECT {keys}, ax.sq, {wide} FROM {fell} f JOIN ax USING ({keys}))")
            ctes.append(sql_order(f"{name}_o{r}", source, f"{name}_a{r}", keys))
            ctes.append(sql_split(f"{name}_n{r}", f"{name}_o{r}", keys, levels, bits, m))
            pick = ", ".join(f"CASE WHEN n.error < o.error THEN n.{c} ELSE o.{c} END AS {c}" for c in ["error", *[f"e{e}_{x}" for e in (0, 1) for x in CHANNELS]])
            ctes.append(f"{name}_{r + 1} AS (SELECT {', '.join(f'o.{k}' for k in keys.split(', '))}, {pick}, coalesce(n.error < o.error, false) AS fell FROM {name}_{r} o LEFT JOIN {name}_n{r} n USING ({keys}))")
    ctes.append(sql_box("box", source, keys))
    ctes.append(sql_coded("best", source, [*[(f"{n}_{r}", four) for n, _, four in kinds for r in ((rounds, 0) if rounds else (0,))], ("box", True)], keys, m))
    return ", ".join(ctes).replace(" AS (", " AS MATERIALIZED (")


def _pixels(weighted: bool = False) -> str:
    w = "CASE WHEN max(a) OVER (PARTITION BY vec_id) = 0 THEN 1 ELSE a END" if weighted else "1"
    return f"{fixtures.SQL_TEXELS}, px AS (SELECT vec_id, texel, r, g, b, {w} AS w FROM tex)"


HEX = "lower(array_to_string(list_transform(c, lambda x: printf('%02X', x)), ''))"
#: Rounds of the iterative fit in SQL; no block of the test tables goes on for longer.
SQL_ROUNDS = 7


def partition_sql() -> str:
    """All 128 partitions of each block, each subset fitted."""
    n = f"{MEM}, {fixtures.SQL_TEXELS}, px AS MATERIALIZED (SELECT vec_id, m.subsets, m.partition, m.subset, texel, r, g, b, 1 AS w FROM tex JOIN mem m USING (texel))"
    keys = "vec_id, subsets, partition, subset"
    fit = f"{sql_axis('ax', 'px', keys)}, {sql_order('ord', 'px', 'ax', keys)}, {sql_split('fit', 'ord', keys, cluster.QUARTER, cluster.FULL_BITS, (1, 1, 1))}"
    return f"""WITH {n}, {fit}, su AS (SELECT DISTINCT {keys} FROM px), al AS (SELECT vec_id, subsets, partition, CAST(sum(coalesce(error, 0)) AS BIGINT) AS error FROM su LEFT JOIN fit USING ({keys}) GROUP BY vec_id, subsets, partition)
    SELECT vec_id, subsets, partition, error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, subsets, partition) AS o FROM al) WHERE o = 1"""


def round_trip_sql() -> str:
    fit = lambda n, rounds: f"SELECT vec_id, '{n}' AS fit, error FROM (WITH {sql_fit('px', 'vec_id', rounds=rounds)} SELECT vec_id, error FROM best)"
    box = f"SELECT vec_id, 'range' AS fit, error FROM (WITH {sql_box('box', 'px', 'vec_id')}, {sql_coded('best', 'px', [('box', True)], 'vec_id', METRICS['uniform'])} SELECT vec_id, error FROM best)"
    return f"WITH {_pixels()} SELECT label, fit, count(*) AS blocks, CAST(sum(error) AS BIGINT) AS error FROM (SELECT DISTINCT vec_id, label FROM tex) JOIN ({fit('cluster', 0)} UNION ALL {fit('iterative', SQL_ROUNDS)} UNION ALL {box}) USING (vec_id) GROUP BY label, fit"


def documents_sql() -> str:
    px = f"{fixtures.sql_text_codes('documents', 'doc_id', 'text', 64)}, px AS MATERIALIZED (SELECT vec_id, block, t AS texel, c[4*t+1] AS r, c[4*t+2] AS g, c[4*t+3] AS b, 1 AS w FROM cod, range(16) s(t))"
    digest = "(" + " + ".join(f"c[{k + 1}] * {pow(257, k, DIGEST)}" for k in range(8)) + f") % {DIGEST}"
    return f"""WITH {px}, {sql_fit('px', 'vec_id, block')}, bx AS (SELECT vec_id, block, error FROM (WITH {sql_coded('bb', 'px', [('box', True)], 'vec_id, block', METRICS['uniform'])} SELECT * FROM bb))
    SELECT vec_id AS doc_id, count(*) AS blocks, CAST(sum(best.error) AS BIGINT) AS error, CAST(sum(bx.error) AS BIGINT) AS box_error, count(*) FILTER (best.error > bx.error) AS worse, CAST(sum({digest} * (block % 1009 + 1) % {DIGEST}) AS BIGINT) AS digest
    FROM best JOIN bx USING (vec_id, block) GROUP BY vec_id"""


def _fit(weighted: bool = False, **options) -> str:
    return f"WITH {_pixels(weighted)}, {sql_fit('px', 'vec_id', **options)} SELECT vec_id, {HEX} AS bytes, error FROM best"


def alphas(spark, d):
    """Alpha bytes of the embeddings' blocks by the better of both books, with their error."""
    return alpha.both_books(vectors(spark, d), ["vec_id"]).select("vec_id", hex_bytes("alpha").alias("bytes"), "error")


def alphas_sql() -> str:
    inner = "list_filter(v, lambda x: x > 0 AND x < 255)"
    levels = {True: ", ".join(["b", "a", *(f"({7 - k} * b + {k} * a) // 7" for k in range(1, 7))]), False: ", ".join(["a", "b", *(f"({5 - k} * a + {k} * b) // 5" for k in range(1, 5)), "0", "255"])}
    ends = f"SELECT vec_id, v, 0 AS book, list_min(v) AS low, list_max(v) AS high FROM bl UNION ALL SELECT vec_id, v, 1, coalesce(list_min({inner}), 0), coalesce(list_max({inner}), 0) FROM bl"
    word = lambda h: "(" + " + ".join(f"(codes[{8 * h + k + 1}] << {3 * k})" for k in range(8)) + ")"
    return f"""WITH {fixtures.SQL_TEXELS}, bl AS (SELECT vec_id, list(a ORDER BY texel) AS v FROM tex GROUP BY vec_id), en AS ({ends}),
    mv AS (SELECT vec_id, v, book, i, j, low + i AS a, high - j AS b FROM en, range({alpha.MOVES}) s(i), range({alpha.MOVES}) t(j) WHERE low + i < high - j OR (book = 1 AND low + i <= high - j)),
    lv AS (SELECT *, CASE WHEN book = 0 THEN [{levels[True]}] ELSE [{levels[False]}] END AS l FROM mv),
    cd AS (SELECT *, list_transform(v, lambda x: list_min(list_transform(range(8), lambda k: (x - l[k + 1]) * (x - l[k + 1]) * 8 + k))) AS m FROM lv),
    er AS (SELECT *, CAST(list_sum(list_transform(m, lambda x: x // 8)) AS BIGINT) AS error, list_transform(m, lambda x: CAST(x % 8 AS BIGINT)) AS codes FROM cd),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, book, i, j) AS o FROM er),
    byt AS (SELECT vec_id, error, CASE WHEN book = 0 THEN [b, a] ELSE [a, b] END || [{word(0)} & 255, ({word(0)} >> 8) & 255, {word(0)} >> 16, {word(1)} & 255, ({word(1)} >> 8) & 255, {word(1)} >> 16] AS c FROM best WHERE o = 1)
    SELECT vec_id, {HEX} AS bytes, error FROM byt"""


QUERIES = {
    "jn4_agg11_both_books": alphas, "win3_agg15_cluster_fit": fit_query(), "win3_cluster_fit_four_perceptual": fit_query(metric="perceptual", three=False), "prj7_iterative_fit": fit_query(iterate=True), "prj7_weighted_fit": fit_query(weighted=True),
    "scale_win3_documents": documents, "flt6_two_stage_partitions": partitions_of, "agg4_cluster_round_trip": round_trip,
}
SQL = {
    "jn4_agg11_both_books": alphas_sql(), "win3_agg15_cluster_fit": _fit(), "win3_cluster_fit_four_perceptual": _fit(metric="perceptual", three=False), "prj7_iterative_fit": _fit(rounds=SQL_ROUNDS), "prj7_weighted_fit": _fit(weighted=True),
    "scale_win3_documents": documents_sql(), "flt6_two_stage_partitions": partition_sql(), "agg4_cluster_round_trip": round_trip_sql(),
}
