import hashlib
import random
import re

from blockloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    fine = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine[k](m[0])]


def test_base_same_as_the_patterns():
    draw = random.Random(1)
    bits = ["a@b.c", "x@y", "@", ".", "1", "255.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (017) 555-7713", "+", "-", " ", "é", "012", "a.b-c@d.e.f@g.h", "999.1.1.1", "0000.1.2.3"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 14)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain(text), text
    pii.base_spans("1" * 300000 + "a" * 300000 + "@" + "a." * 100000)  # no squares


def test_bootstrap_and_digest(spark, documents):
    seeds = [c for c in (str(4539578763621480 + 7 * k) for k in range(140)) if luhn(c)]
    assert len(seeds) >= 12
    rows = [(i, f"é pay by account no {c} today") for i, c in enumerate(seeds)]
    rows += [(100, "my account no 4111111111111112 again"), (101, "order 4111111111111112 shipped"), (102, "code 1234567890123456 and mail a@b.co")]
    rows += [(103, None), (104, ""), (104, ""), (None, "mail x.y@z.org"), (105, "9 " * 40000)]
    got = {r.doc_id: r for r in pii.op9_pii(documents(rows)).collect()}
    assert got[100].spans == "id:14:30" and got[100].n_card == 0 and got[100].n_id == 1
    assert got[101].spans == "" and got[102].spans == "email:31:37"
    for i, t in rows:
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.KINDS[:4])
    assert pii.op9_pii(documents(rows)).count() == len(rows)


def test_bootstrap_finds_forms_of_no_base_pattern(spark, documents):
    new = [f"zk-{4100 + k}-qx{k}" for k in range(24)]
    rows = [(i - 900, f"the ticket for user{i}@mail.org was opened") for i in range(200)]
    rows += [(100 + i, f"a ticket for {v} was closed") for i, v in enumerate(new)]
    rows += [(200 + i, f"see parcel {v} at once") for i, v in enumerate(new)]
    rows += [(300, "see parcel WW/77/2210 at once"), (301, "about ww-7712-ab7 here")]
    got = {r.doc_id: r.spans for r in pii.op9_pii(documents(rows)).collect()}
    assert all(got[100 + i] == f"id:13:{13 + len(v)}" for i, v in enumerate(new))  # by the context of the seeds, whatever the form
    assert all(got[200 + i] == f"id:11:{11 + len(v)}" for i, v in enumerate(new))  # by identifiers that a round found
    assert got[300] == "id:11:21" and got[301] == ""


def secret(k):
    return hashlib.sha1(b"%d" % k).hexdigest()


def test_keyed_seeds_are_a_minority(monkeypatch):
    found = [bool(pii.keyed_spans(f'token = "{secret(k)}"', [])) for k in range(1000)]
    assert 60 < sum(found) < 140
    monkeypatch.setattr(pii, "SEEDS", 1)
    spans = lambda t: [t[s:e] for _, s, e in pii.keyed_spans(t, pii.base_spans(t))]
    assert spans("API_KEY: 'Zx81kk20' and password=\"a1b2c3d4e5\"") == ["Zx81kk20", "a1b2c3d4e5"]
    assert spans('the token = "word" or secret: none') == [] == spans('password = "joe7@mail.org"') == spans('x = "0123456789abcdef"')
    assert spans("secret_key => abcd1234efgh5678ij.") == ["abcd1234efgh5678ij."] and spans('token = "4111111111111111aa"') == ["4111111111111111aa"]
    pii.keyed_spans("token=" * 100000 + "1", [])
    pii.keyed_spans("token='" * 100000 + "1", [])  # no squares


def test_contexts_find_the_secrets_that_are_no_seeds(spark, documents):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    kinds = [lambda k: f'token = "{secret(k)}"', lambda k: f'{{"session_pin":"{secret(k)[:7]}x4"}}' if k % 3 else f'password="{secret(k)[:12]}"']
    rows = [(k, f"{say(9)} {kinds[k % 2](k)} {say(9)}") for k in range(400)]
    rows += [(1000 + k, f"{say(6)} page {k} of v{k} and the {10 ** 15 + k} {say(4)}") for k in range(300)]
    got = {r.doc_id: r.spans for r in pii.op9_pii(documents(rows)).collect()}
    known = [k for k in range(0, 400, 2) if pii.keyed_spans(rows[k][1], [])]
    assert 8 <= len(known) < 40
    found = [k for k in range(0, 400, 2) if k not in known and got[k] == "id:{0}:{1}".format(a := rows[k][1].index(secret(k)), a + 40)]
    assert len(found) >= 0.9 * (200 - len(known))
    assert sum("password=" in t and bool(got[k]) for k, t in rows) > 0.9 * sum("password=" in t for _, t in rows)
    assert not any("id" in got[i] for i, _ in rows if i >= 1000)


def test_candidates_after_a_key():
    value = lambda t: [t[o["start"] : o["end"]] for o in pii.occurrences(t, [])]
    assert value('password="a1b2c3"') == ["a1b2c3"] and value('{"pin":"77x",') == ["77x"] and value("see http://a.b/1 at 12:30.") == ["http://a.b/1", "12:30"]
    assert pii.occurrences('my password="a1b2c3"', [])[0]["patterns"][:2] == ["password _", "my password _"]
    assert [pii.outline(x) for x in ("a1", "Ab-9", "12", "ab", "a1@b", "é7")] == ["9a", "-9Aa", "", "", "", "9a"]


def test_mask(spark, documents):
    rows = [(1, "mail x.y@z.org or +1 (017) 555-7713 é 4111 1111 1111 1111."), (2, None), (3, "clean"), (3, "clean")]
    got = pii.mask(documents(rows))
    assert got.columns == documents(rows).columns
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect()) == [(1, "mail <email> or <phone> é <card>.", 33), (2, "", 0), (3, "clean", 5), (3, "clean", 5)]
    assert pii.mask(documents([])).collect() == [] and pii.op9_pii(documents([])).collect() == []


def plain_trusted(edges, rounds, trust, support, share):
    """The scoring of the graph, by dictionaries."""
    score = {v: float(seed) for _, v, seed, _ in edges}
    for k in range(rounds):
        of = {}
        for p, v, _, o in edges:
            of.setdefault(p, {}).setdefault(o, []).append(score[v])
        found = {}
        for p, by in of.items():
            known = sum(y > 0 for x in by.values() for y in x)
            total = 0
            for o, x in by.items():
                n = sum(y > 0 for y in x)
                total += len(x) if o and n >= support and n >= share * len(x) else sum(x)
            confidence = total / (sum(map(len, by.values())) + 1)
            if known >= support and confidence >= trust:
                found[p] = confidence
        score = {v: 1.0 if seed else max((found[p] for p, w, _, _ in edges if w == v and p in found), default=0.0) for _, v, seed, _ in edges}
    return found


def test_pattern_graph_against_a_plain_version(spark):
    draw = random.Random(3)
    for trust, share in ((0.5, 2), (0.7, 2), (0.7, 0.5)):
        seeds = {f"v{k}": draw.random() < 0.6 for k in range(80)}
        edges = {(f"p{draw.randrange(25) if draw.random() < 0.5 else k % 6}", f"v{k}") for k in range(80) for _ in range(draw.randint(1, 4))}
        edges = [(p, v, seeds[v], ("", "9a", "9A")[int(v[1:]) % 3]) for p, v in sorted(edges)]
        want = plain_trusted(edges, 3, trust, 3, share)
        got = {r.pattern: r.confidence for r in pii.trusted_patterns(spark.createDataFrame(edges, "pattern string, value string, seed boolean, outline string"), 3, trust, 3, share).collect()}
        assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        assert want != plain_trusted(edges, 1, trust, 3, share)
        assert share > 1 or want != plain_trusted(edges, 3, trust, 3, 2)


def test_contexts_are_whole_words_at_any_distance():
    far = "x" * 300
    text = f"{far}   member{' ' * 200}:  4711  {'-' * 100}  {far} end"
    words = pii.Words(text)
    s = text.index("4711")
    assert words.before(s) == [far, "member"] and words.after(s + 4) == "-" * 100
    assert words.context(s, s + 4)[1] == f"{pii.short(far)} member _" and len(pii.short(far)) < 70
    assert pii.Words("tel:+49 30").before(4) == ["^", "tel"] and pii.Words("a 12").after(4) == "^"


def test_candidates_of_any_length_and_without_digits(spark, documents):
    rows = [(i, f"contact person is user{i}@mail.example today") for i in range(30)]
    rows += [(100, "contact person is @nobody today"), (101, "contact person is 7 today"), (102, f"contact person is {'k9' * 5000} today"), (103, "the rain was 7 today"), (104, "contact person is late today")]
    got = {r.doc_id: r.spans for r in pii.op9_pii(documents(rows)).collect()}
    assert got[100] == "id:18:25" and got[101] == "id:18:19" and got[102] == "id:18:10018" and not got[103] and not got[104]
