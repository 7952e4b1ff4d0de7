import math
import random

import numpy as np

from blockloom.llm import negatives


def plain(rows, every=100, best=5, low=80):
    """All pairs, from (vec_id, vector, label)."""
    ok = [(n, i, l, [math.floor(256 * x) for x in v]) for n, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, q in ok:
        if i is None or i % every:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m, l) for m, j, l, v in ok if m != n and len(v) == len(q))
        for p in [x for x in all_ if x[4] == label][:best]:
            fair = [x for x in all_ if x[4] != label and low * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(i, None if p[1] else p[2], r + 1, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(fair[:best])]
    return sorted(map(repr, out))


SHAPE = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], f"{SHAPE}, rank int, high string")


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def mixed_rows():
    draw = random.Random(4)
    vector = lambda w: [round(draw.gauss(0.3, 1), 2) * w for _ in range(6)]
    rows = [(i, vector(draw.choice([0.1, 1, 1, 5])), draw.randrange(4)) for i in range(900)]
    rows += [(i, [1.0, -2.0, 0.5, 0.0, 0.0, 3.0], i % 3) for i in range(900, 1300)]  # one vector, a third of all rows
    rows += [(100, None, 1), (200, [float("nan")] * 6, 1), (300, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (400, [float("-inf")] * 6, 2), (500, [1.0] * 6, None)]
    rows += [(600, [], 1), (601, [], 1), (602, [], 2), (None, [9.0] * 6, 1), (None, [8.5] * 6, 2), (700, [4.0] * 6, 1), (700, [4.0] * 6, 1), (700, [4.0] * 6, 2), (800, [0.0] * 6, 3), (900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1)]
    return rows


def test_same_as_all_pairs(spark):
    rows = mixed_rows()
    want = plain(rows)
    assert len(want) > 100
    assert found(negatives.hard_negatives(table(spark, rows))) == want
    assert found(negatives.hard_negatives(table(spark, rows), bucket=40, lot=2, block=3)) == want
    assert found(negatives.hard_negatives(table(spark, rows), low=50, bucket=100)) == plain(rows, low=50)


def test_query_moves_labels(spark):
    rows = mixed_rows()
    moved = [(i, v, (l + 1) % 10 if l is not None and i is not None and i % 7 == 0 else l) for i, v, l in rows]
    assert found(negatives.op11_negatives(table(spark, rows))) == plain(moved)


def test_short_buckets_are_not_visited(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(0, 1, 5) * (50 if i < 300 else 0.5)).round(2).tolist(), int(draw.integers(3))) for i in range(3000)]
    sent = []

    def counted(df, name, plain=negatives.stored):
        out = plain(df, name)
        if name == "rest":
            sent.append(out.count())
        return out

    looked = []
    monkeypatch.setattr(negatives, "stored", counted)
    own = negatives.Windows.search
    small = {"most": 1.0, "ids": b"", "rows": b"", "labels": b""}
    monkeypatch.setattr(negatives.Windows, "search", lambda self, b, same: looked.append(b["most"]) or own(self, b, same))
    got = negatives.hard_negatives(spark.createDataFrame(rows, SHAPE), every=10, bucket=50, lot=2, block=40).where("anchor_id < 300")
    assert found(got) == [x for x in plain(rows, every=10) if int(x[1:].split(",")[0]) < 300]
    block = dict(rows=np.array([1]), labels=np.array([0]), norms=np.array([2.0]), counts=np.array([1]), highs=np.array([90]), floors=np.array([80]))
    w = negatives.Windows({**{c: x.tobytes() for c, x in block.items()}, "item": 8, "data": np.array([2]).tobytes()}, 5)
    w.search(small, False)  # 2 * 1 < 80: nothing is unpacked
    assert len(w.open(39.0)) == 0 and len(w.open(40.0)) == 1


def test_wide_vectors_and_large_numbers(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [float(draw.randint(-3, 9)) for _ in range(400)], i % 2) for i in range(250)]
    monkeypatch.setattr(negatives, "BYTES", 8 * 400 * 30)
    assert found(negatives.hard_negatives(spark.createDataFrame(rows, SHAPE))) == plain(rows)
    rows = [(i, [draw.randint(1, 9) * 1e5, draw.randint(1, 9) * 1e4 + 0.25], i % 2) for i in range(250)]  # products beyond 2^53
    assert found(negatives.hard_negatives(spark.createDataFrame(rows, SHAPE))) == plain(rows)


def test_empty_and_few(spark):
    assert negatives.op11_negatives(spark.createDataFrame([], SHAPE)).collect() == []
    assert negatives.op11_negatives(spark.createDataFrame([(100, [1.0], 1), (None, None, None)], SHAPE)).collect() == []
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    assert found(negatives.hard_negatives(spark.createDataFrame(few, SHAPE))) == ["(0, 1, 1, 2, 65536, 58880)"]


def test_least_score_of_a_window():
    for s in [*range(400), 9 * 10**18 + 7]:
        assert s - s // 100 * 20 - s % 100 * 20 // 100 == -(-80 * s // 100)
