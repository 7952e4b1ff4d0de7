import random

from blockloom.llm import decontaminate as d


def least(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance():
    draw = random.Random(1)
    for _ in range(300):
        a = "".join(draw.choice("abc ") for _ in range(draw.randint(1, 90)))
        t = "".join(draw.choice("abc ") for _ in range(draw.randint(0, 120)))
        for most in (1, 10, 100):
            assert d.distance_within(a, t, most) == (x if (x := least(a, t)) <= most else None)


def test_same_as_every_item_against_every_text(spark, documents):
    draw = random.Random(3)
    words = ["alpha", "be", "gamma", "delta", "of", "the", "omega", "pi"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, say(draw.randint(3, 40)).title() + ".") for i in range(30)] + [(30, None), (31, "!!"), (32, ""), (5, "omega pi"), (None, say(12))]
    rows = []
    for k in range(80):
        text = say(draw.randint(0, 80))
        if k % 2 and (held := items[draw.randrange(30)][1]):
            held = list(held)
            for _ in range(draw.randint(0, len(held) // 15)):
                held[draw.randrange(len(held))] = draw.choice("xyz-")
            text += "\n" + "".join(held) + " " + say(20)
        rows.append((k, text))
    rows += [(100, None), (101, ""), (101, ""), (None, items[3][1]), (102, say(30000))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.contaminated, r.n_items, tuple(r["items"]), r.least_distance) for r in d.op7_decontaminate(documents(rows), bench).collect()}
    want = set()
    for i, t in rows:
        t, hits = d.normal(t or ""), {}
        for name, item in items:
            if (item := d.normal(item or "")) and (x := 0 if item in t else least(item, t) if len(t) < 9999 else 999) <= int(len(item) * d.ERRORS):
                hits[name] = min(x, hits.get(name, x))
        ids = tuple(sorted(hits, key=lambda x: (x is None, x)))
        want.add((i, bool(hits), len(hits), ids, min(hits.values(), default=None)))
    assert got == want
    assert "size" in d.clean(documents(rows), bench).columns


def test_gram_hashes():
    codes = d.characters("the cat and the dog sat on the é mat and the cat and the dog")
    grams, every = d.Grams(codes), set()
    for n in range(1, 21):
        got = grams.of(n)
        assert len(got) == len(codes) - n + 1 and (d.Grams(codes[3 : 3 + n]).of(n) == got[3]).all()
        seen = {}
        for k, h in enumerate(got.tolist()):
            assert seen.setdefault(h, codes[k : k + n].tolist()) == codes[k : k + n].tolist()
        assert len(seen) == len({tuple(codes[k : k + n].tolist()) for k in range(len(got))})
        assert not every & set(seen)
        every |= set(seen)


def test_items_that_share_an_opening(spark, documents, monkeypatch):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    opening = "Which of the following statements about the subject is true: "
    bench = [(k, opening + " ".join(word() for _ in range(9))) for k in range(150)]
    rows = [(k, f"{' '.join(word() for _ in range(30))} {opening} {' '.join(word() for _ in range(30))}") for k in range(150)]
    edited = list(bench[3][1])
    for at in range(5, 70, 11):  # the edits spoil the opening and leave the rest whole
        edited[at] = "#" if edited[at] == " " else "q"
    rows += [(500, "some " + bench[7][1] + " more"), (501, "".join(edited)), (502, bench[9][1].replace("e", "e", 1)[:-9] + "x" + bench[9][1][-8:])]
    sent = []

    def counted(df, name, plain=d.stored):
        out = plain(df, name)
        if name == "candidates":
            sent.append(sum(len(r.asked) for r in out.collect()))
        return out

    monkeypatch.setattr(d, "stored", counted)
    got = {r.doc_id: tuple(r["items"]) for r in d.op7_decontaminate(documents(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    items = {i: d.normal(t) for i, t in bench}
    assert got == {i: tuple(k for k, x in items.items() if least(x, d.normal(t)) <= int(len(x) * d.ERRORS)) if i >= 500 else () for i, t in rows} and got[500] == (7,) and got[502] == (9,)
    assert 2 <= sent[0] < 20  # of 150 times 153


def test_pieces_keep_the_pigeonhole():
    draw = random.Random(5)
    for _ in range(500):
        item = "".join(draw.choice("abcdef ") for _ in range(draw.randint(1, 300)))
        plain = d.pieces(item, d.ERRORS)
        some = d.apart(item, d.ERRORS, [draw.random() < 0.4 for _ in plain])
        assert len(some) == len(plain) == int(len(item) * d.ERRORS) + 1
        ends = [(s, s + len(p)) for s, p in some]
        assert all(item[s:e] == p and e > s for (s, e), (_, p) in zip(ends, some)) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        assert all(len(p) <= 20 for _, p in plain)


def test_very_long_text(spark, documents):
    bench = [(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "quick brown")]
    long = "lorem ipsum dolor " * 120_000
    rows = [(1, long), (2, long + bench[0][1].upper() + long), (3, long.replace(" ", "") + " " + bench[0][1].replace("lazy", "lasy"))]
    got = {r.doc_id: (tuple(r["items"]), r.least_distance) for r in d.op7_decontaminate(documents(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {1: ((), None), 2: ((1, 2), 0), 3: ((1, 2), 0)}


def test_a_full_bit_table_changes_nothing(spark, documents, monkeypatch):
    rows = [(k, f"some words and question number {k} of the set, as it was put in that year" if k % 3 else "other words") for k in range(30)]
    bench = spark.createDataFrame([(k, f"Question number {k} of the set as it wes put in that year") for k in range(30)], "item_id long, text string")
    want = sorted(map(repr, d.find_items(documents(rows), bench).collect()))
    monkeypatch.setattr(d, "FILTER", 15)
    assert sorted(map(repr, d.find_items(documents(rows), bench).collect())) == want


def test_empty(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.op7_decontaminate(documents([]), bench).collect() == []
    assert [r.contaminated for r in d.op7_decontaminate(documents([(1, "a")]), bench).collect()] == [False]
