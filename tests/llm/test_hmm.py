import math
import random
import sys
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from blockloom.llm import hmm
from blockloom.llm.common import in_fold, stored, table


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def texts(n, seed=1):
    draw = random.Random(seed)
    two = [[f"{p}{k}" for k in range(30)] for p in "xy"]
    return [(i, " ".join(draw.choice(two[i % 2]).upper() if draw.random() < 0.1 else draw.choice(two[i % 2]) for _ in range(draw.choice([0, 1, 5, 40])))) for i in range(n)]


def fitted(docs, **sizes):
    blocks = stored(hmm.encode(docs, ~in_fold("doc_id", 5, 1)), "blocks")
    return blocks, stored(hmm.vocabulary(blocks, **sizes), "members")


def learned(rows):
    return [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]


def plain_first(learn, states):
    """The first model, word by word."""
    n = Counter(w for t in learn for w in t)
    raw = {w: hmm.first_shares(np.array([xxhash.xxh64_intdigest(w)], np.uint64), np.array([c]), states)[0] for w, c in n.items()}
    total = sum(raw.values())
    moves = np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(moves, 0.9)
    return np.full(states, 1 / states), moves, {w: x / total for w, x in raw.items()}


def plain_round(learn, start, moves, emit):
    """One round of Baum-Welch by recursions without slices, and the log likelihood before it."""
    states, n = len(start), Counter(w for t in learn for w in t)
    s_, m_, e_, logs = np.full(states, hmm.EVEN / states), np.full((states, states), hmm.EVEN / states), {w: hmm.PRIOR * np.full(states, c / sum(n.values())) for w, c in n.items()}, 0.0
    for t in learn:
        alpha, scale = [], []
        for k, w in enumerate(t):
            a = (start if k == 0 else alpha[-1] @ moves) * emit[w]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        beta = np.ones(states)
        for k in range(len(t) - 1, -1, -1):
            e_[t[k]] = e_[t[k]] + alpha[k] * beta
            if k:
                back = emit[t[k]] * beta / scale[k]
                m_ += moves * np.outer(alpha[k - 1], back)
                beta = moves @ back
        s_ += alpha[0] * beta
        logs += sum(map(math.log10, scale))
    total = sum(e_.values())
    return s_ / s_.sum(), m_ / m_.sum(1, keepdims=True), {w: x / total for w, x in e_.items()}, logs


def plain_score(start, moves, emit, unknown, text):
    a, logs = None, 0.0
    for w in tokens(text):
        p = (1 - unknown) * emit[w] if w in emit else np.full(len(start), unknown)
        a = (start if a is None else a @ moves) * p
        logs, a = logs + math.log10(a.sum()), a / a.sum()
    return logs


def test_same_as_word_by_word(spark, documents):
    rows = [*texts(120), (500, None), (501, ""), (502, "new words only"), (3, "x1"), (3, "x1"), (None, "y1 y2"), (504, "x1 y1 " * 20000)]
    learn = learned(rows)
    seen = Counter(w for t in learn for w in t)
    n, v = sum(seen.values()), len(seen)
    model, likelihood = plain_first(learn, 3), []
    for _ in range(2):
        *model, logs = plain_round(learn, *model)
        likelihood.append(logs)
    unknown = max(sum(c == 1 for c in seen.values()) / n, 0.5 / (n + 0.5 * (v + 1)))
    for docs in (documents(rows), documents(rows).repartition(5)):
        blocks, members = fitted(docs, states=3, per_bucket=20)
        m, emitted, found = hmm.train(blocks, members, rounds=2, states=3)
        assert (m.n, m.v) == (n, v) and math.isclose(m.unknown, unknown) and np.allclose(found, likelihood, rtol=1e-5)
        assert np.allclose(m.start, model[0], rtol=1e-4) and np.allclose(m.moves, model[1], rtol=1e-4)
        got = {}
        for r in hmm.score(blocks, emitted, m).collect():
            got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.base_score, r.score))
        want = {}
        for i, t in rows:
            base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
            want.setdefault(i, []).append((len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), base, plain_score(*model, unknown, t)))
        assert got.keys() == want.keys()
        for i, some in want.items():
            assert np.allclose(sorted(some), sorted(got[i]), rtol=1e-4, atol=1e-4)
    assert np.allclose(sum(model[2].values()), 1)  # so each state's probabilities, with the unknown's, add up to 1


def test_expected_counts_same_as_all_paths():
    learn = [tokens(t) for t in ("a b a", "b", "c a b d", None)]
    start, moves, emit = plain_first(learn, 2)
    *got, logs = plain_round(learn, start, moves, emit)
    w_start, w_moves, w_logs = np.full(2, hmm.EVEN / 2), np.full((2, 2), hmm.EVEN / 2), 0.0
    n = Counter(w for t in learn for w in t)
    w_emit = {w: hmm.PRIOR * np.full(2, c / sum(n.values())) for w, c in n.items()}
    for t in learn:
        ways = {z: start[z[0]] * np.prod([moves[a, b] for a, b in zip(z, z[1:])]) * np.prod([emit[w][k] for k, w in zip(z, t)]) for z in product(range(2), repeat=len(t))}
        all_ = sum(ways.values())
        w_logs += math.log10(all_)
        for z, p in ways.items():
            w_start[z[0]] += p / all_
            for a, b in zip(z, z[1:]):
                w_moves[a, b] += p / all_
            for k, w in zip(z, t):
                w_emit[w][k] += p / all_
    assert np.allclose(got[0], w_start / w_start.sum()) and np.allclose(got[1], w_moves / w_moves.sum(1, keepdims=True)) and math.isclose(logs, w_logs)
    assert all(np.allclose(got[2][w], w_emit[w] / sum(w_emit.values())) for w in n)


def test_training_raises_likelihood_and_beats_the_base(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    blocks, members = fitted(docs)
    *_, found = hmm.train(blocks, members, rounds=4)
    assert found == sorted(found) and found[-1] > found[0]
    got = hmm.op1_hmm(docs).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({r.train_tokens for r in got}) == 1 and got[0].train_tokens == sum(r.n_tokens for r in got if not r.held_out)


def test_slices_do_not_matter(monkeypatch):
    lengths = np.array([3, 1, 9, 2])
    monkeypatch.setattr(hmm, "SLICE", 4)
    assert [x.tolist() for x in hmm.slices(lengths)] == [[2], [0], [3, 1]]


def test_empty(spark, documents):
    assert hmm.op1_hmm(documents([])).collect() == []
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = hmm.op1_hmm(documents([(only, "a b")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]


class Counted(np.ndarray):
    """An array that counts what is done to it and to what comes of it."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kw):
        Counted.done += 1
        plain = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs]
        into = {"out": tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in out)} if out else {}
        found = getattr(ufunc, method)(*plain, **into, **kw)
        return out[0] if out else found.view(Counted) if isinstance(found, np.ndarray) else found


def test_steps_are_scaled_together():
    lengths = np.array([4000, 3999, 17, 9, 8, 7, 1])
    lay, draw = hmm.layout(lengths), np.random.default_rng(3)
    model = hmm.Model(np.array([0.2, 0.5, 0.3]), draw.dirichlet([1, 1, 1], 3), 1, 1, 0.1)
    emitted = draw.random((lengths.sum(), 3)) * 1e-25  # eight of them are still a double
    Counted.done = 0
    alpha, scale = hmm.forward(model, emitted.view(Counted), lay.offsets)
    assert Counted.done < 2 * lengths[0]
    Counted.done = 0
    beta = hmm.backward(model, emitted.view(Counted), scale, lay.offsets)[0]
    assert Counted.done < 2 * lengths[0]
    first = np.cumsum(lengths) - lengths
    for f, n in zip(first, lengths):
        own, a, b = emitted[lay.at[f : f + n]], None, np.ones(3)
        for k, at in enumerate(lay.at[f : f + n]):
            a = (model.start if a is None else a @ model.moves) * own[k]
            assert math.isclose(scale[at], a.sum(), rel_tol=1e-9)
            a = a / a.sum()
            assert np.allclose(alpha[at], a, rtol=1e-9)
        for k in range(n - 1, -1, -1):
            at = lay.at[f + k]
            assert np.allclose(beta[at], b, rtol=1e-9)
            b = model.moves @ (own[k] * b / scale[at])


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_tokens_of_odd_bytes(kind):
    draw = random.Random(4)
    some = [*(bytes([k]) for k in range(256)), *[b" "] * 40, *[b"\xc3\x89", b"\xe2\x80\x83", b"AZ", b"\r\n"] * 5]
    rows = [None, b"", b" ", b"  A ", b"\x00", *(b"".join(draw.choice(some) for _ in range(draw.randrange(50))) for _ in range(500))]
    lengths, found, words = hmm.numbered(pa.array(rows, kind))
    words, at = words.to_pylist(), 0
    for text, n in zip(rows, lengths):
        assert [words[k] for k in found[at : at + n]] == [*(text or b"").lower().split(), b""]
        at += n
    assert at == len(found) and len(set(words)) == len(words)


def test_no_python_step_for_each_token():
    calls = 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(called)
    try:
        hmm.numbered(pa.array([b"one two three " * 30_000]))
    finally:
        sys.setprofile(None)
    assert calls < 1000


def test_blocks_end_where_they_are_full():
    draw = random.Random(7)
    rows = [(i, True, None if n == 0 else b"w" * n) for i, n in enumerate(draw.choice([0, 1, 9, 10, 11, 35]) for _ in range(300))]
    want, size = [[]], 0
    for i, _, text in rows:
        if size >= 20:
            want, size = [*want, []], 0
        want[-1].append(i)
        size += len(text or b"")
    for some in (1, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + some]], t) for c, t in enumerate([pa.int64(), pa.bool_(), pa.binary()])], ["i", "ok", "text"]) for k in range(0, 300, some)]
        assert [[i for b in lot for i in b.column(0).to_pylist()] for lot in hmm.filled(batches, 20)] == want


def test_counts_travel_once(spark, documents):
    blocks, members = fitted(documents(texts(60)), states=3, per_bucket=20)
    assert members.where(f"kind = {hmm.MEMBER} and n is not null").count() == 0
    assert hmm.first_emissions(members, np.ones(3)).where("n is not null").count() == 0
    _, emitted, _ = hmm.train(blocks, members, rounds=1, states=3)
    assert emitted.where("n is null").count() == 0 and emitted.count() > 0
