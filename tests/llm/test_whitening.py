import math
import random
from decimal import Decimal

import numpy as np
import pytest

from blockloom.llm import whitening

SHAPE = "vec_id long, embedding array<double>"


def plain(rows, most=4):
    """(vec_id, n, deviation) of all rows in order, their whitened components, shares of variance."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in ok})
    n, width = len(distinct), len(distinct[0])
    total = [sum(x[k] for x in distinct) for k in range(width)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total)] for x in distinct])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    own = [(i, n, sum((n * a - s) ** 2 for a, s in zip(x, total))) for i, x in ok]
    white = np.array([[(n * a - s) / n for a, s in zip(x, total)] for _, x in ok]) @ vector / np.sqrt(value)
    return own, white, value / np.trace(centred.T @ centred / n)


def held(df):
    """{vec_id: {component: row}}; ids must differ."""
    out = {}
    for r in df.collect():
        assert r.component not in out.setdefault(r.vec_id, {})
        out[r.vec_id][r.component] = r
    return out


def compare(df, rows):
    got = held(df)
    own, white, share = plain(rows)
    assert set(got) == {i for i, _, _ in own}
    sign = {}
    for (i, n, deviation), w in zip(own, white):
        for k in range(len(share)):
            r = got[i][k + 1]
            assert (r.n, r.deviation, r.deviation_exact) == (n, deviation, Decimal(deviation))
            sign.setdefault(k, 1 if r.whitened * w[k] > 0 else -1)
            assert abs(r.whitened - sign[k] * w[k]) < 1e-8
            assert abs(r.explained - share[k]) < 1e-10 and 0 <= r.identity_error < 1e-9
        assert len(got[i]) == len(share)


def test_same_as_plain(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0.5, k + 1) for k in range(7)]) for i in range(400)]
    rows += [(i, rows[5][1]) for i in range(400, 700)]  # one vector, nearly half of all rows: once in the fit
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 7), (903, [float("inf")] * 7), (904, [])]
    table = spark.createDataFrame([(*r, 1, "n") for r in rows + bad], SHAPE + ", component int, n string")
    compare(whitening.op13_whitening(table), rows)


def test_far_from_zero(spark):
    draw = random.Random(4)
    rows = [(i, [1e6 + draw.randrange(9) / 256, -1e6 + draw.randrange(5) / 256, draw.random()]) for i in range(300)]
    compare(whitening.op13_whitening(spark.createDataFrame(rows, SHAPE)), rows)


def test_few_components_and_large_deviations(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [0.25, -3e8])]
    got = held(whitening.op13_whitening(spark.createDataFrame(rows, SHAPE)))
    own, _, _ = plain(rows)
    assert {i: len(x) for i, x in got.items()} == {1: 2, 2: 2, 3: 2}
    assert all(got[i][1].deviation_exact == d and got[i][1].deviation == (d if d < 1 << 63 else None) for i, _, d in own) and any(d >= 1 << 63 for _, _, d in own)


def test_no_variance(spark):
    one = held(whitening.op13_whitening(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SHAPE)))
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for x in one.values() for r in x.values()] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    line = held(whitening.op13_whitening(spark.createDataFrame([(i, [i / 4, i / 2, 1.0]) for i in range(9)], SHAPE)))
    assert all(abs(x[1].explained - 1) < 1e-12 and x[2].whitened == x[3].whitened == 0 and x[1].identity_error < 1e-12 for x in line.values())


def test_widths_nulls_and_repeats(spark, monkeypatch):
    draw = random.Random(5)
    two, three = ([(100 * w + i, [draw.random() for _ in range(w)]) for i in range(20)] for w in (2, 3))
    got = whitening.op13_whitening(spark.createDataFrame(two + three, SHAPE))
    compare(got.where("vec_id < 300"), two)
    compare(got.where("vec_id >= 300"), three)
    rows = [(None, [0.1, 0.2]), (7, [0.3, 0.1]), (7, [0.3, 0.1]), (7, [0.2, 0.9])]
    assert sorted((r.vec_id is None, r.component, r.n) for r in whitening.op13_whitening(spark.createDataFrame(rows, SHAPE)).collect()) == sorted((v is None, k, 3) for v, _ in rows for k in (1, 2))
    monkeypatch.setattr(whitening, "WIDEST", 2)
    with pytest.raises(ValueError):
        whitening.op13_whitening(spark.createDataFrame(three, SHAPE))


def test_empty_table(spark):
    empty = whitening.op13_whitening(spark.createDataFrame([], SHAPE))
    assert empty.collect() == [] and empty.columns == whitening.op13_whitening(spark.createDataFrame([(1, [0.1])], SHAPE)).columns
    assert whitening.op13_whitening(spark.createDataFrame([(1, None), (2, [])], SHAPE)).collect() == []
