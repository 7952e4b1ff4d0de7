import itertools

import numpy as np
import pytest

from blockloom.operators import cluster, partitions

BITS = cluster.COLOUR_BITS
SOME = np.random.default_rng(7)


def wide(g, bits):
    return [(x << 8 - n) | (x >> 2 * n - 8) if n < 8 else x for x, n in zip(g, bits)]


def plain_split(x, w, axis, levels, bits):
    """The least squared error over all splits, by least squares on each of them, ends rounded to their grid."""
    order = sorted(range(16), key=lambda t: (int(x[t] @ axis), t))
    whole, best = levels[0], None
    for cuts in itertools.combinations_with_replacement(range(17), len(levels) - 1):
        share = np.repeat(levels, np.diff([0, *cuts, 16]))
        a, b = share / whole * np.sqrt(w[order]), (1 - share / whole) * np.sqrt(w[order])
        if np.linalg.matrix_rank(np.stack([a, b], 1), 1e-9) < 2:
            continue
        exact = np.linalg.lstsq(np.stack([a, b], 1), x[order] * np.sqrt(w[order])[:, None], rcond=None)[0]
        top = (1 << np.array(bits)) - 1
        ends = [wide(np.clip(np.floor(e * top / 255 + 0.5 + 1e-9), 0, top).astype(int), bits) for e in exact]
        error = sum(int(v) * int((whole * c - s * p - (whole - s) * q) ** 2) for t, s in zip(order, share) for c, p, q in zip(x[t], *ends) for v in [w[t]])
        best = error if best is None else min(best, error)
    return best


@pytest.mark.parametrize("levels", [cluster.HALVES, cluster.THIRDS, cluster.QUARTER])
def test_best_split_is_least_squares(levels):
    bits = cluster.FULL_BITS if levels == cluster.QUARTER else BITS
    x = np.concatenate([SOME.integers(0, 256, (2, 16, 3)), SOME.integers(90, 99, (1, 16, 3)), np.full((1, 16, 3), 77)])
    w = np.concatenate([np.ones((3, 16), np.int64), SOME.integers(0, 3, (1, 16))])
    axis = cluster.principal_axis(x, w)
    error, _ = cluster.best_split(x, w, axis, levels, bits, (1, 1, 1))
    # rounding at a tie may go either way in doubles, which changes an error a little
    for k in range(4):
        want = plain_split(x[k], w[k], axis[k], levels, bits)
        assert want is not None and abs(error[k] - want) <= 0.01 * want


def test_axis_is_principal():
    x = (SOME.normal(0, 1, (5, 16, 1)) * SOME.normal(0, 40, (5, 1, 3)) + 128 + SOME.normal(0, 3, (5, 16, 3))).clip(0, 255).astype(np.int64)
    axis = cluster.principal_axis(x, np.ones((5, 16), np.int64))
    for v, own in zip(axis, x):
        main = np.linalg.eigh(np.cov(own.T))[1][:, -1]
        assert abs(v @ main) / np.linalg.norm(v) > 0.999


def test_never_worse_and_always_ends():
    e = np.concatenate([SOME.integers(0, 256, (200, 16, 4)), np.repeat(SOME.integers(0, 256, (20, 1, 4)), 16, axis=1), np.zeros((1, 16, 4), np.int64)])
    plain, once, over = (cluster.block_bytes(e, (1, 1, 1), True, False, i) for i in (False, False, True))
    assert (plain[1] <= plain[2]).all() and (plain[1] < plain[2]).mean() > 0.8 and (plain[0] == once[0]).all()
    assert (over[1] <= plain[1]).all() and over[1].sum() < plain[1].sum()


def test_bytes_decode_to_their_error(spark):
    from blockloom.operators import decode

    e = SOME.integers(0, 256, (60, 16, 4))
    e[50:, :, :3] = SOME.integers(0, 3, (10, 16, 1)) * 100 + [0, 8, 30]  # both ends and what is half way
    rows = spark.createDataFrame([(k, [int(v) for v in b.reshape(-1)]) for k, b in enumerate(e)], "vec_id long, e array<long>")
    found = cluster.cluster_fit(rows, ["vec_id"]).collect()
    coded = spark.createDataFrame([(r.vec_id, 0, r.c) for r in found], "vec_id long, block long, c array<long>")
    far = {}
    for t in decode.bc1(coded, False).collect():
        far[t.vec_id] = far.get(t.vec_id, 0) + sum((int(e[t.vec_id, t.texel, k]) - v) ** 2 for k, v in enumerate((t.r, t.g, t.b)))
    assert far == {r.vec_id: r.error for r in found}
    assert any(r.c[0] | r.c[1] << 8 <= r.c[2] | r.c[3] << 8 for r in found)  # three colours


def test_weights():
    e = SOME.integers(0, 256, (40, 16, 4))
    e[:, 8:, 3] = 0
    e[:20, :8, :3] = 100 + e[:20, :8, :3] // 64
    _, error, box = cluster.block_bytes(e, (1, 1, 1), True, True, False)
    assert (error <= box).all() and (error[:20] * 20 < box[:20]).all()  # texels of alpha 0 count for nothing
    e[:, :, 3] = 0
    clear, alike = (cluster.block_bytes(e, (1, 1, 1), True, w, False) for w in (True, False))
    assert (clear[0] == alike[0]).all()
    e[:, :, 3], e[:, 5, 3] = 0, 9  # one texel counts: no split has an answer, the box stays
    assert (cluster.block_bytes(e, (1, 1, 1), True, True, False)[1] == cluster.block_bytes(e, (1, 1, 1), True, True, False)[2]).all()


def test_metric_counts():
    e = SOME.integers(0, 256, (50, 16, 4))
    by = {m: cluster.block_bytes(e, m, False, False, False)[1].sum() for m in ((1, 1, 1), (1, 9, 1))}
    green = cluster.block_bytes(e, (1, 1, 1), False, False, False)[0]
    c0, c1 = green[:, 0] + (green[:, 1] << 8), green[:, 2] + (green[:, 3] << 8)
    other, _ = cluster.coded(e[:, :, :3], np.ones((50, 16), np.int64), c0, c1, True, (1, 9, 1))
    assert by[1, 9, 1] < other.sum()


def test_two_stages_find_the_exhaustive_winner():
    x = np.concatenate([SOME.integers(0, 256, (3, 16, 3)), np.full((1, 16, 3), 9), SOME.integers(0, 2, (2, 16, 3)) * 200])
    mask = partitions.TWO[37]
    x = np.concatenate([x, [[[250, 10, 10 + t] if mask >> t & 1 else [10, 200 - t, 30] for t in range(16)]]])
    at, error, looked = cluster.best_partitions(x)
    names, members, owner = cluster.masks()
    every = np.zeros((len(x), len(names)))
    for m, k in zip(members, owner):
        w = np.repeat(m[None].astype(np.int64), len(x), 0)
        if m.sum() > 1:
            every[:, k] += cluster.best_split(x, w, cluster.principal_axis(x, w), cluster.QUARTER, cluster.FULL_BITS, (1, 1, 1))[0]
    assert (at == every.argmin(1)).all() and (error == every.min(1)).all()
    assert looked < len(x) * len(names) / 2 and names[at[-1]] == (2, 37)
    assert (cluster.least_errors(x, members, owner) * 4096 <= every + 1e-3).all()
