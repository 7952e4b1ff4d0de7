import numpy as np
from pyspark.sql import functions as F

from blockloom.operators import alpha, decode, encode


def some(n=80):
    draw = np.random.default_rng(4)
    e = draw.integers(0, 256, (n, 16, 4))
    e[20:40, :, 3] = draw.choice([0, 255, 100, 104, 109, 115], (20, 16))  # what the second book is for
    e[40:50, :, 3] = draw.choice([0, 255], (10, 16))
    e[50:60, :, 3] = draw.integers(0, 256, (10, 1))
    e[60:70, :, 3] = 90 + draw.integers(0, 4, (10, 16))
    return e


def test_bytes_decode_to_their_error_and_are_never_worse(spark):
    e = some()
    rows = spark.createDataFrame([(k, [int(v) for v in b.reshape(-1)]) for k, b in enumerate(e)], "vec_id long, e array<long>")
    found = alpha.both_books(rows, ["vec_id"]).collect()
    own = {r.vec_id: (r.alpha, r.error) for r in found}
    ramp = {r.vec_id: r.alpha for r in encode.ramp_alpha(rows).select("vec_id", "alpha").collect()}

    def errors(by):
        coded = spark.createDataFrame([(k, 0, [*map(int, a), *[0] * 8]) for k, a in by.items()], "vec_id long, block long, c array<long>")
        far = {}
        for t in decode.bc3(coded).select("vec_id", "texel", F.col("a").cast("long").alias("a")).collect():
            far[t.vec_id] = far.get(t.vec_id, 0) + (int(e[t.vec_id, t.texel, 3]) - t.a) ** 2
        return far

    got, before = errors({k: a for k, (a, _) in own.items()}), errors(ramp)
    assert got == {k: x for k, (_, x) in own.items()}
    assert all(got[k] <= before[k] for k in got) and 10 * sum(got[k] for k in range(20, 40)) < sum(before[k] for k in range(20, 40)) and all(got[k] == 0 for k in range(40, 60))
    assert sum(own[k][0][0] > own[k][0][1] for k in range(20)) > 15 and sum(own[k][0][0] <= own[k][0][1] for k in range(20, 40)) > 15
