import hashlib
import math
from fractions import Fraction

from blockloom.llm import mixing


def plain(rows):
    size = [len((t or "").encode().split()) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    has = {s: sum(z for z, r in zip(size, rows) if r[3] == s) for s in names}
    target, free, left = {}, set(names), sum(size)
    while True:  # reshare until none is above its cap
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > 3 * has[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * has[s]
        left, free = left - sum(3 * has[s] for s in over), free - over
    return size, has, target | share


def test_targets_and_words(spark, documents):
    rows = []
    for k in range(400):
        rows.append((k, "w " * (k * 37 % 90), "en", ["big", "b", "c", None, "e", "tiny"][0 if k % 3 == 0 else k % 6]))
    rows += [(900, None, "en", "no words"), (901, "", None, "no words"), (7, "a b", "en", "b"), (None, "a", "en", "b"), (902, "x " * 20000, "en", "big")]
    size, has, target = plain(rows)
    got = mixing.op3_mix(documents(rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.size, r.source_size) for r in got) == sorted((z, has[r[3]]) for z, r in zip(size, rows))
    taken = {}
    of = {r[0]: r[3] for r in rows}
    for r in got:
        assert math.isclose(r.target, float(target[of[r.doc_id]]), rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    for s, t in target.items():
        most = max(z for z, r in zip(size, rows) if r[3] == s)
        assert abs(taken[s] - t) <= 3 * most + 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.op3_mix(documents(rows)).collect()))


def test_same_as_one_pass_in_order(spark, documents):
    rows = [(k, "w " * (k % 11), "en", "ab"[k % 5 == 0]) for k in range(200)]
    size, has, target = plain(rows)
    order = sorted(range(200), key=lambda k: (size[k], hashlib.md5(str(k).encode()).hexdigest()))
    want, place = {}, {}
    for k in order:
        s = rows[k][3]
        n = place[s] = place.get(s, 0) + 1
        rate = float(target[s]) / has[s]
        want[k] = (math.floor(n * rate + mixing.OFFSET) - math.floor((n - 1) * rate + mixing.OFFSET)) * size[k]
    assert {r.doc_id: r.taken for r in mixing.op3_mix(documents(rows)).collect()} == want


def test_empty(spark, documents):
    assert mixing.op3_mix(documents([])).collect() == []
