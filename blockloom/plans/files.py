"""Queries that go through files and streams."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.operators import decode
from blockloom.plans import blocks
from blockloom.sources import fixtures
from blockloom.sources.block_files import as_block_files, as_png_files, in_folder, png_header, rasters_as_png, read_block_ranges, read_blocks, read_png, read_png_folders, write_files
from blockloom.streaming import updates
from blockloom.streaming.decode import block_stream, decode_available


def scratch(spark) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; in local mode a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/blockloom-{uuid.uuid4().hex}"


def file_round_trip(spark, d):
    """Every embedding as an image of 16 by 8 in a block file, written, read and decoded."""
    images = fixtures.codes(spark, d, 8).select(F.format_string("%d.blk", "vec_id").alias("name"), F.lit(16).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), "block", "c")
    path = scratch(spark)
    write_files(as_block_files(images), path)
    found = read_blocks(spark, path, 8).withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.blk$", 1).cast("long"))
    return decode.bc1(found, False)


def png_round_trip(spark, d):
    """Every embedding as a grey PNG of 8 by 8, written and read."""
    pixels = blocks.pixels(spark, d).select(F.format_string("%d.png", "image").alias("name"), "x", "y", F.array("v").alias("v"))
    path = scratch(spark)
    write_files(as_png_files(pixels), path)
    found = read_png(spark, path)
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image"), "x", "y", F.element_at("v", 1).alias("v"))


def file_ranges(spark, d):
    """Texts of the pages as block files of one row of blocks, read by ranges of 4096 blocks, of each from the ninth on, and summed up.

    What remains of a page after its last whole block is left out."""
    pages = fixtures.text_codes(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html", 16)
    each = pages.withColumn("width", 4 * F.count("*").over(Window.partitionBy("vec_id")))
    path = scratch(spark)
    write_files(as_block_files(each.select(F.format_string("%d.blk", "vec_id").alias("name"), "width", F.lit(4).cast("long").alias("height"), "block", "c")), path)
    found = read_block_ranges(spark, path, 16, 4096).where("block >= 8")
    code = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: F.pmod(a * 257 + x, F.lit(1_000_000_007)))
    each = found.select(F.regexp_extract("path", r"(\d+)\.blk$", 1).cast("long").alias("page_id"), "width", F.pmod(code * (F.pmod("block", F.lit(1009)) + 1), F.lit(1_000_000_007)).alias("code"))
    return each.groupBy("page_id", "width").agg(F.count("*").alias("blocks"), F.sum("code").alias("digest"))


#: Sides of the images that events update.
SIDES = (62, 30)


def event_updates(events):
    """Events as updates of their user's image: some of them start off the blocks or end within one."""
    e = F.col("event_id")
    x, y = 4 * F.pmod(e, F.lit(16)) + F.when(F.pmod(e, F.lit(7)) == 0, 1).otherwise(0), 4 * F.pmod(F.floor(e / 16), F.lit(8))
    w, h = F.least(4 * (1 + F.pmod(e, F.lit(3))), F.lit(SIDES[0]) - F.col("x")), F.least(4 * (1 + F.pmod(e, F.lit(2))), F.lit(SIDES[1]) - F.col("y"))
    own = events.select(F.col("user_id").alias("image"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), x.cast("long").alias("x"), y.cast("long").alias("y"), F.col("event_id"), F.floor(F.col("value") * 100).alias("code"))
    return own.withColumn("w", (w - F.when(F.pmod(e, F.lit(11)) == 0, 1).otherwise(0)).cast("long")).withColumn("h", h.cast("long")).select(*updates.UPDATE)


def streamed_updates(spark, d):
    """The images of all users once their events have been applied as a stream of updates; refused updates as block -1."""
    like = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "value")
    stream = event_updates(block_stream(spark, f"{d}/events.parquet*", like))
    now, refused = updates.apply_available(stream, *SIDES, scratch(spark))
    per = refused.groupBy("image").agg(F.max("seq").alias("seq"), F.count("*").alias("updates"))
    return now.select("image", "block", "seq", "code", "updates").unionByName(per.select("image", F.lit(-1).cast("long").alias("block"), "seq", F.lit(None).cast("long").alias("code"), "updates"))


UPDATES_SQL = f"""WITH e AS (SELECT user_id AS image, ts, event_id AS seq, 4 * (event_id % 16) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS x, 4 * ((event_id // 16) % 8) AS y, CAST(floor(value * 100) AS BIGINT) AS code FROM events),
    u AS (SELECT *, least(4 * (1 + seq % 3), {SIDES[0]} - x) - CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS w, least(4 * (1 + seq % 2), {SIDES[1]} - y) AS h FROM e),
    f AS (SELECT *, x % 4 = 0 AND y % 4 = 0 AND w > 0 AND h > 0 AND (w % 4 = 0 OR x + w = {SIDES[0]}) AND (h % 4 = 0 OR y + h = {SIDES[1]}) AS fine FROM u),
    b AS (SELECT image, ts, seq, code, (y // 4 + j) * {-(-SIDES[0] // 4)} + x // 4 + i AS block FROM f, range(4) s(i), range(3) t(j) WHERE fine AND 4 * i < w AND 4 * j < h),
    o AS (SELECT *, row_number() OVER (PARTITION BY image, block ORDER BY ts DESC, seq DESC) AS o, count(*) OVER (PARTITION BY image, block) AS updates FROM b)
    SELECT image, block, seq, code, updates FROM o WHERE o = 1 UNION ALL SELECT image, -1, max(seq), NULL, count(*) FROM f WHERE NOT fine GROUP BY image"""
RANGES_SQL = f"WITH {fixtures.sql_text_codes('pages', 'page_id', 'html', 16)}, w AS (SELECT *, 4 * count(*) OVER (PARTITION BY vec_id) AS width FROM cod) SELECT vec_id AS page_id, width, count(*) AS blocks, CAST(sum(list_reduce([0::BIGINT] || c, lambda a, x: (a * 257 + x) % 1000000007) * (block % 1009 + 1) % 1000000007) AS BIGINT) AS digest FROM w WHERE block >= 8 GROUP BY vec_id, width"


def channel_sums(images):
    """(path, width, height, pixels, sum_r, sum_g, sum_b) of images of three channels: each value times its column and row, from 1."""

    def run(batches):
        for b in batches:
            sums = []
            for width, height, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "data"))):
                p = np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(np.int64)
                sums.append(np.arange(1, height + 1) @ np.tensordot(p, np.arange(1, width + 1), (1, 0)))
            own = np.array(sums, np.int64).reshape(-1, 3)
            pixels = pc.multiply(b.column("width"), b.column("height"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "width", "height")), pixels, *map(pa.array, own.T)], names=["path", "width", "height", "pixels", "sum_r", "sum_g", "sum_b"])

    return images.mapInArrow(run, "path string, width long, height long, pixels long, sum_r long, sum_g long, sum_b long")


def interlaced_round_trip(spark, d):
    """Texts of the pages as interlaced RGB images of 61 pixels a row, written and read: sums over their channels by row.

    The last row is filled up with blanks; images of pages are as large as the pages. A page is a row until its file is written.
    """
    pages = fixtures.dealt(spark.read.parquet(f"{d}/pages.parquet").where("octet_length(html) > 0").select("page_id", "html"))
    data = F.rpad(F.encode("html", "UTF-8"), (F.ceil(F.octet_length("html") / 183) * 183).cast("int"), F.lit(b" "))
    rasters = pages.select(in_folder(F.format_string("%d.png", "page_id")).alias("name"), F.lit(61).alias("width"), F.lit(3).alias("channels"), data.alias("data"))
    path = scratch(spark)
    write_files(rasters_as_png(rasters, interlaced=True), path)
    own = channel_sums(read_png_folders(spark, path))
    return own.select(F.regexp_extract("path", r"(-?\d+)\.png$", 1).cast("long").alias("page_id"), "width", "height", "pixels", "sum_r", "sum_g", "sum_b")


def headers(spark, d):
    """What the first bytes of each embedding's PNG say; every third file lacks the signature."""
    pixels = blocks.pixels(spark, d).select("image", "x", "y", F.array("v").alias("v"))
    files = as_png_files(pixels, "image")
    content = F.when(F.pmod("image", F.lit(3)) == 0, F.concat(F.lit(b"GIF89a"), "content")).otherwise(F.col("content"))
    return files.select("image", content.alias("content")).select("image", *[x.alias(n) for n, x in png_header(F.col("content")).items()])


def streamed(spark, d):
    """The blocks of the embeddings as a stream, decoded."""
    like = fixtures.embeddings(spark, d)
    stream = block_stream(spark, f"{d}/embeddings.parquet*", like)
    return decode_available(stream, lambda df: decode.bc1(fixtures.coded(df, 8), False), scratch(spark))


INTERLACED_SQL = """WITH p AS (SELECT page_id, hex(encode(html)) AS h, strlen(html) AS n FROM pages WHERE strlen(html) > 0), f AS (SELECT page_id, h || repeat('20', (183 - n % 183) % 183) AS h FROM p),
    x AS (SELECT page_id, unnest(regexp_extract_all(h, '.{6}')) AS t, unnest(range(strlen(h) // 6)) AS o, strlen(h) // 366 AS height FROM f), c AS (SELECT page_id, height, (o % 61 + 1) * (o // 61 + 1) AS k, [CAST('0x' || substr(t, 2 * i + 1, 2) AS BIGINT) FOR i IN range(3)] AS v FROM x)
    SELECT page_id, 61::BIGINT AS width, height, count(*) AS pixels, CAST(sum(v[1] * k) AS BIGINT) AS sum_r, CAST(sum(v[2] * k) AS BIGINT) AS sum_g, CAST(sum(v[3] * k) AS BIGINT) AS sum_b FROM c GROUP BY page_id, height"""
QUERIES = {"src2_snk1_block_files": file_round_trip, "src1_snk2_png_files": png_round_trip, "stream_dec1": streamed, "flt2_flt3_png_headers": headers, "src1_interlaced_pages": interlaced_round_trip, "src2_file_ranges": file_ranges, "flt7_stream_updates": streamed_updates}
SQL = {"src2_file_ranges": RANGES_SQL, "flt7_stream_updates": UPDATES_SQL, "src1_interlaced_pages": INTERLACED_SQL, "src2_snk1_block_files": blocks.SQL["dec1_bc1_rgb"], "src1_snk2_png_files": blocks.SQL["prj3_there_and_back"], "stream_dec1": blocks.SQL["dec1_bc1_rgb"], "flt2_flt3_png_headers": "SELECT vec_id AS image, vec_id % 3 <> 0 AS is_png, " + ", ".join(f"CASE WHEN vec_id % 3 <> 0 THEN {v} END AS {n}" for n, v in (("width", 8), ("height", 8), ("depth", 8), ("colour", 0))) + " FROM embeddings"}
