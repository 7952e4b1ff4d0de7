import math
import zlib

import numpy as np
import pytest

from blockloom.llm import language
from blockloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.op2_language(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, language.op2_language(docs.repartition(3)).collect()))


def test_odd_texts(spark, documents):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (i % 7 + 1), "en" if i % 2 else "de") for i in range(80)]
    odd = [(200, None, "en"), (201, "", "en"), (202, "12 -- 34!", "de"), (203, "the dog " * 300000, None), (None, "und die katze", None), (3, "the cat", "en"), (3, "the cat", "en")]
    got = {(r.doc_id, r.lang_pred) for r in language.op2_language(documents(rows + odd)).collect()}
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "en"), (None, "de"), (3, "en")} <= got
    kept = language.keep_known(documents(rows + odd))
    assert kept.columns == documents(rows).columns and kept.count() == len(rows) + 4


def test_no_letter_is_und(spark, documents):
    rows = [(i, "the cat and the dog", "en") for i in range(20)]
    odd = ["½ ² ①", "½ 12", "Ⅷ ⅳ", "\u0301\u0300", "१२३", "_ __"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op2_language(documents([*rows, *((100 + k, t, None) for k, t in enumerate(odd)), (200, "½ a", None), (201, "ª", None), (202, "字", None)])).collect()}
    assert all(got[100 + k] == ("und", 0.0) for k in range(len(odd)))
    assert all(got[k][0] == "en" for k in (200, 201, 202))


def test_keep_known_learns_from_every_label(spark, documents):
    rows = [(i, "der hund und die katze " * (i % 7 + 1) if zlib.crc32(str(i).encode()) % 4 == 2 else "the cat and the dog " * (i % 7 + 1)) for i in range(160)]
    rows = [(i, t, t[:3]) for i, t in rows]
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language, "predict", lambda docs, model, plain=language.predict: seen.append(model) or plain(docs, model))
        assert language.keep_known(documents(rows)).count() == len(rows)
    assert seen[0].names == ["der", "the"]  # all rows of one label are in the quarter that op2_language holds out


def test_nothing_to_learn(spark, documents):
    assert language.op2_language(documents([])).collect() == []
    assert [r.lang_pred for r in language.op2_language(documents([(1, "a b", None)])).collect()] == ["und"]


def test_slices_count_each_gram_once(monkeypatch):
    text = "Ein Text, der über Grenzen geht. " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "SLICE", 7)
    assert (language.counts(text) == whole).all()


def test_temperature_of_calibrated_logits():
    draw = np.random.default_rng(0)
    logits = draw.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    classes = np.array([draw.choice(3, p=x) for x in p])
    assert abs(language.temperature(logits * 5, classes) - 5) < 0.6


def test_leader_same_as_a_plain_version(monkeypatch):
    monkeypatch.setattr(language, "FEATURES", 12)
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        ids = np.sort(draw.choice(12, draw.integers(1, 6), replace=False))
        x = draw.random(len(ids)) + 0.1
        rows.append((int(draw.integers(0, 3)), ids, x / np.sqrt(x @ x)))
    weights, bias = language.fit(rows, 3)

    # each weight by itself, with numbers and dictionaries
    z, n = {}, {}
    l1, l2 = language.L1, language.L2

    def weight(key):
        own, m = z.get(key, 0.0), n.get(key, 0.0)
        a, b = (l1, l2) if key[0] != "bias" else (0.0, 0.0)
        return 0.0 if abs(own) <= a else -(own - math.copysign(a, own)) / ((language.BETA + math.sqrt(m)) / language.ALPHA + b)

    order = np.random.default_rng(11)
    for _ in range(language.EPOCHS):
        for k in order.permutation(len(rows)):
            y, ids, x = rows[k]
            used = {(f, c): v for f, v in [*zip(ids.tolist(), x.tolist()), ("bias", 1.0)] for c in range(3)}
            now = {key: weight(key) for key in used}
            scores = [sum(now[key] * v for key, v in used.items() if key[1] == c) for c in range(3)]
            total = sum(math.exp(t) for t in scores)
            for key, v in used.items():
                g = (math.exp(scores[key[1]]) / total - (key[1] == y)) * v
                m = n.get(key, 0.0)
                z[key] = z.get(key, 0.0) + g - (math.sqrt(m + g * g) - math.sqrt(m)) / language.ALPHA * now[key]
                n[key] = m + g * g
    assert np.allclose(weights, [[weight((f, c)) for c in range(3)] for f in range(12)]) and np.allclose(bias, [weight(("bias", c)) for c in range(3)])


def test_weights_of_grams_same_as_a_plain_version():
    text = "Ein Text, der über Grenzen geht."
    found = language.counts(text)
    low = f" {text.lower()} "
    grams = [low[k : k + n] for n in (2, 3) for k in range(len(low) - n + 1)]
    assert found.sum() == len(grams) and (found > 0).sum() <= len(set(grams))
    idf = np.linspace(1, 2, language.FEATURES)
    ids, x = language.weighted(found, idf)
    want = [(1 + math.log(found[k])) * idf[k] for k in ids]
    assert np.allclose(x, np.array(want) / math.sqrt(sum(w * w for w in want)))
