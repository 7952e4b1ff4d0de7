import random

import numpy as np

from blockloom.llm import topk


def plain(rows, k=5, every=50):
    import math

    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % every == 0:
            all_ = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j, m) for m, j, v in ok if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, _, j, _) in enumerate(all_[:k])]
    return sorted(map(repr, out))


def test_same_as_all_pairs(spark):
    draw = random.Random(4)
    rows = [(i, [float(f"{draw.gauss(0, 1):.2f}") for _ in range(6)]) for i in range(700)]
    rows += [(i, [1.0, -2.0, 0.5, 0.0, 0.0, 3.0]) for i in range(700, 1000)]  # one large group of copies
    rows += [(50, None), (100, [float("nan")] * 6), (150, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (200, [float("inf")] * 6), (250, []), (251, []), (300, [1.0, 2.0]), (None, [9.0] * 6), (50, [4.0] * 6), (50, [4.0] * 6)]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = plain(rows)
    assert sorted(repr(tuple(r)) for r in topk.op5_topk(table).collect()) == want
    assert sorted(repr(tuple(r)) for r in topk.top_k(table, shard=50, cell=100, block=7, boxes=3).collect()) == want


def test_far_cells_are_not_visited(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 40, (30, 4))
    rows = [(i, (centres[i % 30] + draw.normal(0, 0.2, 4)).round(2).tolist()) for i in range(3000)]
    sent = []

    def counted(df, name, plain=topk.stored):
        found = plain(df, name)
        if name == "visits":
            sent.append(found.count())
        return found

    monkeypatch.setattr(topk, "stored", counted)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=100, shard=50).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain([(i, np.float32(v).astype(float).tolist()) for i, v in rows])
    assert 0 < sent[0] < 60 * 30 / 3  # of 60 queries and 30 cells or more


def test_splits_deal_every_vector():
    draw = np.random.default_rng(1)
    v = draw.integers(-9, 9, (500, 3))
    own = topk.Splits.of(v[:80], 7)
    leaf = own.deal(v)
    assert set(leaf) <= set(range(7)) and len(set(leaf)) == 7 and np.bincount(leaf).max() < 200
    assert set(topk.Splits.of(np.ones((20, 3), np.int64), 5).deal(v)) == {0}
    assert set(topk.Splits.of(np.zeros((0, 3), np.int64), 5).deal(v)) == {0}


def test_wide_vectors(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(3000)]) for i in range(120)]
    monkeypatch.setattr(topk, "BYTES", 8 * 3000 * 25)
    got = topk.op5_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_empty_and_few(spark):
    shape = "vec_id long, embedding array<float>"
    assert topk.op5_topk(spark.createDataFrame([], shape)).collect() == []
    assert topk.op5_topk(spark.createDataFrame([(0, [1.0])], shape)).collect() == []
    assert [tuple(r) for r in topk.op5_topk(spark.createDataFrame([(0, [1.0]), (1, [-0.001])], shape)).collect()] == [(0, 1, 1, -256)]
