"""Every query with SQL against DuckDB, on the smallest tables; properties of tables and decoders."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import decode, lookups, partitions
from blockloom.plans import registry
from blockloom.sources import block_files, fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_same_as_sql(spark, duck, name):
    df = registry.ALL[name](spark, SF)
    found = duck.execute(registry.ALL_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want


def test_queries_read_a_table(spark, tmp_path):
    for name, f in registry.QUERIES.items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
            f(spark, str(tmp_path / "none"))


def test_counts_of_codebooks(spark):
    assert {r.kind: r.books for r in registry.RULES["agg5_agg6_flt5_codebooks"](spark, SF).collect()} == {"five": 9829, "five_with_mirrors": 19532, "seven": 23569}


def test_errors_keep_their_bound(spark):
    assert {(r.bits, r.steps): r.most for r in registry.RULES["src7_worst_errors"](spark, SF).where("most is not null").collect()}.keys() == {(5, 3), (5, 4), (6, 3), (6, 4)}
    worst = lookups.colour_table(spark).where("side = 1").groupBy("bits", "steps").agg(F.max("err").alias("e")).collect()
    assert {(r.bits, r.steps): r.e for r in worst} == {(5, 3): 2, (5, 4): 1, (6, 3): 1, (6, 4): 1}


def test_partitions_cover_each_texel_once(spark):
    assert partitions.members(spark).groupBy("subsets", "partition").agg(F.count_distinct("texel").alias("n")).where("n <> 16").isEmpty()
    assert registry.RULES["win2_anchors"](spark, SF).where("not inside").isEmpty()


def test_swapped_ends_decode_alike(spark):
    draw = random.Random(1)
    rows = []
    for k in range(50):
        a, b = sorted((draw.randrange(65536), draw.randrange(65536)), reverse=True)
        codes = [draw.randrange(4) for _ in range(16)]
        word = sum(c << 2 * i for i, c in enumerate(codes))
        rows.append((k, 0, [*a.to_bytes(2, "little"), *b.to_bytes(2, "little"), *word.to_bytes(4, "little")]))
    got = decode.bc1(spark.createDataFrame(rows, "vec_id long, block long, c array<long>"), False).collect()
    assert len(got) == 800
    for r in got:
        c = rows[r.vec_id][2]
        a, b, code = c[0] | c[1] << 8, c[2] | c[3] << 8, int.from_bytes(bytes(c[4:]), "little") >> 2 * r.texel & 3
        red = [(x >> 11) << 3 | x >> 13 for x in (a, b)]
        assert a == b or r.r == [red[0], red[1], (2 * red[0] + red[1]) // 3, (red[0] + 2 * red[1]) // 3][code]


def test_paletted_images_are_decoded_within_their_rows(spark):
    """Texel by texel, odd sides and missing bytes as well; no texel is a row before the sums."""
    draw = np.random.default_rng(4)
    rows, want = [], {}
    for k, (form, size) in enumerate([*decode.PALETTE_FORMATS.items(), *decode.PALETTE_FORMATS.items()]):
        wide, (width, height), n = k % 2 == 0, [(8, 8), (5, 3), (1, 7), (6, 1)][k % 4], 256 if k % 2 == 0 else 16
        data = draw.integers(0, 256, 2000).astype(np.uint8).tolist()
        at = n * size
        for level in range(3):
            w, h = max(width >> level, 1), max(height >> level, 1)
            for i in range(w * h):
                code = data[at + i] if wide else data[at + i // 2] >> 4 if i % 2 == 0 else data[at + i // 2] & 15
                c = data[code * size : (code + 1) * size]
                v = c[0] | c[1] << 8
                five, six = lambda x: (x & 31) << 3 | (x & 31) >> 2, lambda x: (x & 63) << 2 | (x & 63) >> 4
                rgba = {"rgb8": [*c, 255], "rgba8": c, "r5_g6_b5": [five(v >> 11), six(v >> 5), five(v), 255], "rgba4": [(v >> s & 15) * 17 for s in (12, 8, 4, 0)], "rgb5_a1": [five(v >> 11), five(v >> 6), five(v >> 1), (v & 1) * 255]}[form]
                want.setdefault((k, level, w, h), []).extend(rgba)
            at += w * h if wide else (w * h + 1) // 2
        rows.append((k, form, wide, width, height, bytes(data[:at])))
        rows.append((100 + k, form, wide, width, height, bytes(data[: at - 1])))
    rows += [(200, None, True, 8, 8, b"x" * 2000), (201, "rgb8", True, 8, 8, None), (202, "rgb8", True, 8, 8, b"")]
    images = spark.createDataFrame(rows, "id long, form string, wide boolean, width long, height long, bytes binary")
    assert {(r.id, r.level, r.width, r.height): list(r.data) for r in decode.paletted(images, ["id"], 3).collect()} == want
    sizes = {r[0]: r[3] for r in rows}
    for r in decode.paletted_sums(images, ["id"], 3).collect():
        (w, h), texels = next((key[2:], x) for key, x in want.items() if key[:2] == (r.id, r.level))
        assert r.texels == w * h and [r.sum_r, r.sum_g, r.sum_b, r.sum_a] == [sum(texels[4 * i + c] * (i // w * sizes[r.id] + i % w + 1) for i in range(w * h)) for c in range(4)]
    assert "Generate" not in registry.QUERIES["dec12_paletted"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(4000).selectExpr("id", "sha2(cast(id as string), 512) as t").coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # more splits than can run at once, of which one holds all rows
    try:
        rows = spark.read.parquet(str(tmp_path / "one"))
        held = lambda df: df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert rows.rdd.getNumPartitions() >= 4 and len(held(rows)) == 1
        assert max(r["count"] for r in held(fixtures.dealt(rows))) < 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_png_filters_and_refusals(spark):
    draw = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        p = draw.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        width, height, back = block_files.png_pixels(block_files.png_bytes(p))
        assert (width, height) == (7, 5) and (back == p).all()
    rows = np.array([[1, 5, 6, 7], [2, 1, 1, 1], [3, 4, 4, 4], [4, 9, 9, 9]], np.uint8)
    assert block_files.unfiltered(rows.tobytes(), 4, 3, 1).tolist() == [[5, 11, 18], [6, 12, 19], [7, 13, 20], [16, 25, 34]]
    with pytest.raises(ValueError):
        block_files.png_pixels(b"no image")


def test_files_of_no_whole_blocks_are_refused(spark, tmp_path):
    (tmp_path / "a.blk").write_bytes((5).to_bytes(4, "little") * 2 + b"x" * 8)
    with pytest.raises(Exception, match="not a file of whole blocks"):
        block_files.read_blocks(spark, str(tmp_path), 8).collect()
