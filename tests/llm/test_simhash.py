import random
from itertools import combinations

import numpy as np
import xxhash

from blockloom.llm import components, simhash


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_shingles(text, width):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_same_as_all_pairs(spark, documents):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.choice([1, 3, 8, 60, 120]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(draw.choice([0, 0, 1, 3])):
            near = list(base)
            near[draw.randrange(len(near))] = draw.choice(words).upper()
            rows.append((len(rows), "\t".join(near)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[0][1]), (503, rows[0][1]), (None, "a b c d e"), (None, None), (504, "x " * 70000)]
    got = simhash.op8_simhash(documents(rows)).collect()
    fp = [plain_fingerprint(t, 4) for _, t in rows]
    root = plain_components(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(i, low.get(root[k], i))
    want = [(i, f"{fp[k]:016x}", low.get(root[k])) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_keep_one_finds_edited_copies(spark, documents):
    draw = random.Random(8)
    words, rows = [f"w{i}" for i in range(500)], []
    for _ in range(30):
        base = [draw.choice(words) for _ in range(draw.choice([4, 60, 200]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):  # chains: each copy is an edit of the one before
            base = list(base)
            for _ in range(1 + len(base) // 100):
                base[draw.randrange(len(base))] = draw.choice(words)
            rows.append((len(rows), " ".join(base).upper()))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    fp = [plain_fingerprint(t, 5) for _, t in rows]
    pairs = list(combinations(range(len(rows)), 2))
    like = [(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    bits = [(i, j) for i, j in pairs if (fp[i] ^ fp[j]).bit_count() <= 4]
    want = set(plain_components(range(len(rows)), like + bits).values())
    assert len(want) < len(set(plain_components(range(len(rows)), bits).values())) - 30
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    assert sorted((r.doc_id for r in simhash.keep_one(documents(rows)).collect()), key=str) == sorted([*want, 900], key=str)


def test_parts_of_a_bucket_do_not_matter(spark, documents, monkeypatch):
    draw = random.Random(12)
    base = [f"w{draw.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        near = list(base)
        for _ in range(draw.randint(0, 8)):
            near[draw.randrange(len(near))] = f"x{draw.randrange(9999)}"
        rows.append((i, " ".join(near)))
    sets = [plain_shingles(t, 5) for _, t in rows]
    like = [(i, j) for i, j in combinations(range(60), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = plain_components(range(60), like)
    docs = documents(rows)
    kept = simhash.stored(simhash.fingerprints(docs, ["doc_id"], 5, True), "fingerprints")
    for stars, cell in ((0, 7), (1, 2048), (4, 2048)):
        monkeypatch.setattr(simhash, "STARS", stars)
        monkeypatch.setattr(simhash, "CELL", cell)
        links = [tuple(x) for x in simhash.similar_links(kept, docs, 5, 0.8).collect()]
        assert set(links) <= set(like) and plain_components(range(60), links) == want


def test_sketches_let_similar_sets_through():
    draw = np.random.default_rng(5)
    caught = 0
    for k in range(400):
        n = int(draw.integers(5, 3000))
        share = draw.random() ** 0.5
        a = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < share], draw.integers(0, 1 << 64, int(len(a) * (1 - share)), dtype=np.uint64)]))
        if not len(b):
            continue
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(simhash.least_hashes(s).astype(np.uint8).tobytes() + simhash.parities(s).tobytes(), np.uint8)[None] for s in (a, b))
        found = simhash.alike(x, y, np.array([len(a)]), np.array([len(b)]), 0.8)[0]
        assert found == simhash.alike(x[0], y, len(a), np.array([len(b)]), 0.8)[0]
        assert found or similar < 0.8
        caught += not found
        assert not found or similar > 0.5
    assert caught > 100


def test_lots_of_text_give_the_same_shingles(monkeypatch):
    draw = random.Random(4)
    for n in (0, 1, 3, 4, 5, 200):
        text = "".join(f"W{draw.randrange(50)}" + draw.choice([" ", "\n", "  \t"]) for _ in range(n)).encode()
        want = sorted(x for y in simhash.shingle_lots(text, 4) for x in y.tolist())
        monkeypatch.setattr(simhash, "LOT", 5)
        assert sorted(x for y in simhash.shingle_lots(text, 4) for x in y.tolist()) == want
        monkeypatch.setattr(simhash, "LOT", 1 << 20)
        assert f"{simhash.fingerprint(simhash.shingle_lots(text, 4)) & (1 << 64) - 1:016x}" == f"{plain_fingerprint(text.decode(), 4):016x}"


def test_passes_do_not_change_links(spark, monkeypatch):
    draw = random.Random(2)
    fps = []
    for _ in range(40):
        x = draw.getrandbits(64)
        fps += [x, x ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64), x ^ sum(1 << b for b in draw.sample(range(64), 4))]
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    for at_most in (1 << 40, 1 << 10):
        monkeypatch.setattr(simhash, "PER_PASS", at_most)
        links = simhash.ball_links(table, 4).collect()
        assert plain_components(signed, [tuple(x) for x in links]) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(200, 201), (199, 201), (200, 201)]
    nodes = {n for x in links for n in x}
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(nodes, links).items())


def test_empty(spark, documents):
    assert simhash.op8_simhash(documents([])).collect() == []
