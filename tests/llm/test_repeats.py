import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import repeats


def plain(rows, n=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        if i is not None:
            for k in range(len(t) - n + 1):
                s = t[k : k + n]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if i is not None and least[t[k : k + n]] < i:
                gone[k : k + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed):
    draw = random.Random(seed)
    words = ["alpha", "bé", "gamma", "de", "of", "the", "omega", "pi"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, line = say(40), "a line that very many documents share, word for word and byte for byte"
    rows = [(i, say(draw.randint(0, 60))) for i in range(60)]
    for i in range(60, 160):
        kind = draw.randrange(5)
        text = say(draw.randint(0, 30))
        if kind == 0:
            text = rows[draw.randrange(60)][1]
        elif kind == 1:
            near = list(rows[draw.randrange(60)][1])
            for _ in range(2 if near else 0):
                near[draw.randrange(len(near))] = "x"
            text = "".join(near)
        elif kind == 2:
            text += passage[draw.randint(0, 20) :] + say(5)
        elif kind == 3:
            text += "\n" + line + "\n" + say(10)
        rows.append((i, text))
    rows += [(200, None), (201, ""), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (202, "a" * 500), (203, "a" * 49), (204, "ab" * 3000), (300, "a" * 50)]
    draw.shuffle(rows)
    return rows


def test_same_as_all_strings(spark, documents):
    for seed in (1, 2):
        rows = corpus(seed)
        got = repeats.op10_repeats(documents(rows)).collect()
        assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_many_blocks_buckets_and_hot_grams(spark, documents, monkeypatch):
    rows = corpus(3)
    docs = documents(rows).repartition(40)
    monkeypatch.setattr(repeats, "BUCKET", 1000)
    got = repeats.deduplicated(docs, hot=2).collect()
    assert sorted(repr((*r[:4], hashlib.sha256(r.kept).hexdigest())) for r in got) == plain(rows)


def test_lots_are_whole_groups():
    draw = np.random.default_rng(1)
    gram, size = draw.integers(0, 40, 500).astype(np.uint64), draw.integers(50, 80, 500)
    for most in (1, 1000, 10**9):
        some = list(repeats.lots(gram, size, most))
        assert sorted(np.concatenate(some).tolist()) == list(range(500))
        assert sum(len(set(gram[x].tolist())) for x in some) == len(set(gram.tolist()))
        assert all(size[x].sum() <= most or len(set(gram[x].tolist())) == 1 for x in some)


def test_suffix_sort():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[200:400]
    place = draw.permutation(2900)[:700]
    group = np.sort(draw.integers(0, 5, 700))
    order, new = repeats.suffix_sort(repeats.Hashes(data), place, group, np.full(700, 50))
    text = [(g, data[p : p + 50].tobytes()) for g, p in zip(group.tolist(), place.tolist())]
    assert [text[k] for k in order] == sorted(text)
    assert new.tolist() == [k == 0 or text[order[k]] != text[order[k - 1]] for k in range(700)]


def test_hashes_that_lie_are_found_out(monkeypatch):
    monkeypatch.setattr(repeats.Hashes, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    data = np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60, np.uint8)
    order, new = repeats.suffix_sort(repeats.Hashes(data), np.array([0, 60, 120]), np.zeros(3, int), np.full(3, 50))
    assert [int(data[[0, 60, 120][k]]) for k in order] == [120, 120, 121] and new.tolist() == [True, False, True]


def test_parts_of_a_group_are_sorted_together(monkeypatch):
    draw = np.random.default_rng(3)
    kinds = draw.integers(97, 123, (5, 60)).astype(np.uint8)
    pick = draw.integers(0, 5, 400)
    data, start, size = kinds[pick].ravel(), np.arange(400) * 60, np.full(400, 60)
    for most in (60, 1000, 10**9):
        monkeypatch.setattr(repeats, "LOT", most)
        for whole in (repeats.stretch_hashes(data, start, size), np.zeros(400, np.uint64)):
            assert repeats.leaders(data, start, size, whole).tolist() == [int(np.flatnonzero(pick == k)[0]) for k in pick]


def test_a_phrase_with_many_surroundings_in_one_block(spark, documents):
    draw = random.Random(6)
    piece = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=40))
    phrase = "all rights are reserved by whoever"
    rows = [(i, phrase.join(piece() for _ in range(700))) for i in range(4)]
    rows += [(i, phrase.join(rows[i % 4][1].split(phrase)[k : k + 40])) for i, k in ((10, 5), (11, 300), (12, 610))]
    docs = documents(rows)
    blocks = repeats.stored(repeats.blocks(docs), "blocks")
    flags = repeats.shared_grams(blocks, 0).collect()
    assert any(np.unpackbits(np.frombuffer(r.hot, np.uint8), count=r.n).any() for r in flags)
    assert sorted(repr(tuple(r)) for r in repeats.op10_repeats(docs).collect()) == plain(rows)


def test_blocks_and_buckets_exchange_few_rows(spark, documents):
    """A block gives all its buckets' rows in one batch, and what has no answer comes back as no row."""
    docs = documents(corpus(4)).repartition(6)
    blocks = repeats.stored(repeats.blocks(docs), "blocks")
    flags = repeats.stored(repeats.shared_grams(blocks, 37), "flags")
    steps = []

    class Step:
        def __getattr__(self, name):
            return lambda *a: steps.append(a[0]) if name == "applyInArrow" else self

    repeats.contexts(Step(), Step(), 37)
    for row in blocks.select("block", "doc_id", "data").collect():
        one = spark.createDataFrame([row], "block long, doc_id array<long>, data binary").toArrow()
        made = steps[0](one, flags.where(F.col("flag_of") == row.block).toArrow())
        assert made.num_rows > 10 and len(made.to_batches()) == 1
    stretches = repeats.contexts(blocks, flags, 37).where(F.col("kind") == repeats.STRETCHES)
    told = repeats.answers(stretches).collect()
    assert 0 < len(told) < stretches.count() and all(len(repeats.unpack(r.blob, np.int32, np.uint8, np.uint8, np.int64)[0]) for r in told)


def test_groups_where_hashes_collide(monkeypatch):
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 9, 500).astype(np.uint64), draw.integers(0, 9, 500).astype(np.uint8)
    for _ in range(2):
        order, begin = repeats.groups_of(a, b)
        pairs = [(int(x), int(y)) for x, y in zip(a[order], b[order])]
        assert sorted(order.tolist()) == list(range(500)) and len(begin) == len(set(pairs)) == len({pairs[k] for k in begin})
        monkeypatch.setattr(repeats, "mixed", lambda h: np.zeros(len(h), np.uint64))


def test_text_of_several_megabytes(spark, documents):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(2000)]
    long = " ".join(draw.choice(words) for _ in range(400_000))
    assert len(long) > 2 << 20
    rows = [(5, long), (3, long[700_000:700_300]), (9, long[:100] + "-" * 200 + long[2_000_000:2_000_100]), (7, "=" * 1_500_000), (8, "=" * 60)]
    got = {r.doc_id: r for r in repeats.deduplicated(documents(rows)).collect()}
    want = long.encode()
    assert got[3].n_removed == 0 and bytes(got[5].kept) == want[:700_000] + want[700_300:] and got[5].n_spans == 1
    assert bytes(got[9].kept) == b"-" * 200 and got[9].n_spans == 2
    assert got[7].n_removed == 0 and got[8].n_removed == 60


def test_empty(spark, documents):
    assert repeats.op10_repeats(documents([])).collect() == []
