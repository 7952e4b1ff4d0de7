import datetime
import random

import pytest
from pyspark.sql import functions as F

from blockloom.streaming import updates

WIDTH, HEIGHT = 22, 10
SHAPE = "image long, ts timestamp, seq long, x long, y long, w long, h long, code long"


def made(n, draw):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        x, y = 4 * draw.randrange(6), 4 * draw.randrange(3)
        w, h = min(4 * draw.randrange(1, 4), WIDTH - x), min(4 * draw.randrange(1, 3), HEIGHT - y)
        if draw.random() < 0.2:
            x, w = draw.choice([(x + 1, w), (x, w + 1), (x, 3), (-4, 4), (24, 4), (x, 0)])
        rows.append((0 if draw.random() < 0.4 else draw.randrange(5), start + datetime.timedelta(seconds=draw.randrange(50)), k, x, y, w, h, draw.randrange(1000)))
    return rows


def plain(rows):
    """Final blocks by applying legal updates one after another, and the illegal ones."""
    blocks, refused = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        image, ts, seq, x, y, w, h, code = r
        fine = x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= WIDTH and y + h <= HEIGHT and x % 4 == y % 4 == 0 and (w % 4 == 0 or x + w == WIDTH) and (h % 4 == 0 or y + h == HEIGHT)
        if not fine:
            refused.append(seq)
            continue
        for by in range(y // 4, (y + h - 1) // 4 + 1):
            for bx in range(x // 4, (x + w - 1) // 4 + 1):
                n = blocks.get((image, by * 6 + bx), (0, 0, 0))[2]
                blocks[image, by * 6 + bx] = (seq, code, n + 1)
    return blocks, sorted(refused)


def held(current):
    return {(r.image, r.block): (r.seq, r.code, r.updates) for r in current.collect()}


def stream(spark, path):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_ends_as_a_batch_and_goes_on_after_restart(spark, tmp_path):
    rows = made(240, random.Random(3))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = lambda a, b: spark.createDataFrame(rows[a:b], SHAPE).coalesce(1).write.mode("append").parquet(source)
    part(0, 70)
    part(70, 120)
    now, refused = updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
    blocks, bad = plain(rows[:120])
    assert held(now) == blocks and sorted(r.seq for r in refused.collect()) == bad and bad
    part(120, 240)  # times go back and forth: some of these come late
    now, refused = updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
    blocks, bad = plain(rows)
    assert held(now) == blocks and sorted(r.seq for r in refused.collect()) == bad
    now, _ = updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)  # nothing new
    assert held(now) == blocks


def test_failure_within_a_batch_is_made_good(spark, tmp_path, monkeypatch):
    rows = made(60, random.Random(4))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows[:30], SHAPE).coalesce(1).write.parquet(source)
    updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
    spark.createDataFrame(rows[30:], SHAPE).coalesce(1).write.mode("append").parquet(source)
    own = updates.written

    def failing(changed, batch, out):
        own(changed.limit(3), batch, out)
        raise RuntimeError("lost")

    monkeypatch.setattr(updates, "written", failing)
    with pytest.raises(Exception, match="lost"):
        updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
    monkeypatch.setattr(updates, "written", own)
    now, _ = updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
    assert held(now) == plain(rows)[0]


def test_nulls_are_refused(spark):
    rows = spark.createDataFrame([(1, None, 1, 0, 0, 4, 4, 5), (1, datetime.datetime(2024, 1, 1), 2, 0, 0, 4, 4, 5), (1, datetime.datetime(2024, 1, 1), 3, 0, 0, None, 4, 5)], SHAPE)
    assert [r.fine for r in rows.select(updates.legal(WIDTH, HEIGHT).alias("fine")).collect()] == [False, True, False]
    assert updates.touched(rows, WIDTH, HEIGHT).where(F.col("seq") == 1).isEmpty()


def test_updates_alike_in_time_and_place_end_alike(spark, tmp_path):
    """The state is an aggregate of Spark's own: what comes first does not matter, and no row goes through Python."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, start, 7, 0, 0, 8, 4, code) for code in (5, 9, 2)] + [(1, start - datetime.timedelta(seconds=1), 8, 4, 0, 4, 4, 30), (2, start, 1, 20, 8, 2, 2, 4)]
    for k, order in enumerate((rows, rows[::-1])):
        source, out = str(tmp_path / f"in{k}"), str(tmp_path / f"out{k}")
        spark.createDataFrame(order, SHAPE).coalesce(1).write.parquet(source)
        now, refused = updates.apply_available(stream(spark, source), WIDTH, HEIGHT, out)
        assert held(now) == {(1, 0): (7, 9, 3), (1, 1): (7, 9, 4), (2, 17): (1, 4, 1)} and refused.isEmpty()
    plan = updates.latest(updates.touched(stream(spark, source), WIDTH, HEIGHT))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan and "Python" not in plan
