import re
import zlib

import numpy as np
import pytest

from parlance.llm import toxicity as op
from tests.llm.cases import LONG, ROWS, documents

RNG = np.random.default_rng(3)


def small_net(dtype=np.float64):
    net = op.new_network(5, dtype)
    net["word odds"], net["run odds"] = (RNG.standard_normal(op.ROWS).astype(dtype) for _ in range(2))
    net["bias"] = RNG.standard_normal(len(net["bias"])).astype(dtype)
    return net


def test_gradients():
    """Slopes by back propagation equal differences of the loss, padding included."""
    net, n = small_net(), 3
    gates, target = RNG.standard_normal((5, 6 * op.STATES, n)), np.array([1.0, 0, 1])
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 1, 0], [1, 0, 0]], float)

    def loss():
        return np.logaddexp(0, op.forward(net, gates.__getitem__, mask)).sum() - (target * op.forward(net, gates.__getitem__, mask)).sum()

    trace = {}
    logit = op.forward(net, gates.__getitem__, mask, trace)
    grad, d_gates = op.backward(net, mask, trace, 1 / (1 + np.exp(-logit)) - target)
    for name, array, slope in [(k, net[k], g) for k, g in grad.items()] + [("gates", gates, d_gates)]:
        for at in RNG.permutation(array.size)[:25]:
            x = array.reshape(-1)
            kept, ends = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = kept + step
                ends.append(loss())
            x[at] = kept
            assert slope.reshape(-1)[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-7), name


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def naive_logit(net, text):
    """The greatest logit of all windows of a text, token by token."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    words = [w[k : k + op.TOKEN] for w in words for k in range(0, len(w), op.TOKEN)]

    def row(piece, salt=0):
        h = sum((b + 1) * pow(int(op._BASE), k, 1 << 64) for k, b in enumerate(piece)) + salt
        h %= 1 << 64
        return ((h ^ h >> 31) * int(op._MIX) % (1 << 64)) >> (64 - op.BITS)

    inputs = []
    for w in words:
        runs = [row(w[k : k + op.RUN]) for k in range(len(w))] + [row(w[:k], 1) for k in op.BEGINNINGS]
        inputs.append(np.concatenate([[net["word odds"][row(w)], max(net["run odds"][r] for r in runs)], net["words"][row(w) % op.VECTORS], np.mean([net["runs"][r % op.VECTORS] for r in runs], axis=0)]))
    logits, n = [], op.STATES
    for at in range(0, max(1, len(words) - op.HALF), op.HALF):
        window = inputs[at : at + op.WINDOW]
        states = np.zeros((len(window), 2 * n))
        for k, (name, order) in enumerate((("forth", range(len(window))), ("back", reversed(range(len(window)))))):
            h = np.zeros(n)
            for t in order:
                g = (net["in"] @ window[t] + net["bias"])[3 * k * n : 3 * (k + 1) * n]
                a = net[name] @ h
                z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
                h = (1 - z) * h + z * np.tanh(g[2 * n :] + r * a[2 * n :])
                states[t, k * n : (k + 1) * n] = h
        score = np.tanh(states @ net["attend"].T) @ net["weigh"]
        weight = np.exp(score - score.max())
        logits.append(float(net["judge"] @ (weight / weight.sum() @ states) + net["level"][0]))
    return max(logits)


TEXTS = [b"one", b"A few Words, of\nno weight; \xc3\xa9t\xc3\xa9 x9", b" ".join(b"word%d" % (k % 23) for k in range(16)), b" ".join(b"w%d" % k for k in range(17)), b" ".join(b"Word%d" % (k % 23) for k in range(100)), b"x" * 700 + b" tail", b"end"]


def test_every_window_counts(monkeypatch):
    net = small_net()
    want = [naive_logit(net, t) for t in TEXTS]
    assert op.Texts(TEXTS).worst(net)[0] == pytest.approx(want)
    monkeypatch.setattr(op, "HELD", 3)
    monkeypatch.setattr(op, "AT_ONCE", 2)
    assert op.Texts(TEXTS).worst(net)[0] == pytest.approx(want)
    assert [op.Texts([t]).worst(net)[0][0] for t in TEXTS] == pytest.approx(want)


def test_odds_leave_a_document_out():
    held = np.array([0 * op.ROWS + 5, 1 * op.ROWS + 5, 2 * op.ROWS + 5, 2 * op.ROWS + 9])
    plain, clean, toxic = op.log_odds(held, np.array([0, 1, 1, 0]))
    s = op.SMOOTH / 2
    assert plain[5] == pytest.approx(np.log((2 + s) / (1 + s)), abs=1e-6) and plain[7] == 0
    assert clean[5] == pytest.approx(np.log((2 + s) / s), abs=1e-6) and toxic[5] == pytest.approx(0, abs=1e-6)
    assert toxic[9] == pytest.approx(0, abs=1e-6) and plain[9] == pytest.approx(np.log((1 + s) / s), abs=1e-6)


def test_one_bad_word_in_a_long_text():
    """Learned from short texts, found anywhere in a long one."""
    say = lambda n: [b"word%d" % k for k in RNG.integers(0, 60, n)]
    texts, labels = [], []
    for k in range(240):
        words = say(int(RNG.integers(5, 90)))
        if k % 3 == 0:
            words[int(RNG.integers(0, len(words)))] = b"vile%d" % (k % 40)
        texts.append(b" ".join(words))
        labels.append(int(k % 3 == 0))
    model = op.fit(texts, np.array(labels), 1 / 3, steps=120)
    clean = [b" ".join(say(3000)) for _ in range(4)]
    bad = [b" ".join(w[:at] + [b"vile77"] + w[at:]) for at, w in ((0, say(3000)), (1500, say(3000)), (3000, say(3000)), (2, say(4)))]
    assert op.scores(model, clean).max() < 0.7 <= op.scores(model, bad).min()
    again = np.concatenate([op.scores(model, [t]) for t in clean + bad])
    assert op.scores(model, clean + bad) == pytest.approx(again, abs=2e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op.query(spark, d).join(labels, "doc_id").filter("held_out").collect()
    bad, good = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.85
    assert np.mean([g >= 0.7 for g in good]) < 0.03 and len(bad) > 10


def test_odd_rows(spark):
    texts = spark.createDataFrame([(k, f"{'awful' if k % 2 else 'lovely'} thing number {k}", "x") for k in range(100, 160)] + [(200, None, "x"), (201, " ?! ", "x"), (202, "awful " + LONG, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(100, 160)] + [(None, 1, "x"), (101, None, "x"), (103, 0, "x")], "doc_id long, toxic int, text string")
    out = {r.doc_id: r for r in op.score(texts, labels, steps=60).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    assert all(r.held_out == held(k) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for k, r in out.items()) and len(out) == 63
    assert np.mean([out[k].score for k in range(101, 160, 2)]) > 0.5 > np.mean([out[k].score for k in range(100, 160, 2)])
    share = [k % 2 for k in range(100, 160) if not held(k)] + [0] * (not held(103))
    assert out[200].score == out[201].score == pytest.approx(np.mean(share), abs=1e-6)
    assert {r.score for r in op.score(documents(spark), labels.limit(0)).collect()} == {0.5}
    one = op.score(documents(spark), spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, toxic int")).collect()
    assert {r.score for r in one} == {1.0} and len(one) == len(ROWS)
    assert op.score(documents(spark, []), labels).collect() == []
    got = op.sample_of(texts, labels, "doc_id", "text", "toxic", 3, 1, 5, 16_384)
    assert np.bincount(got[1]).tolist() == [5, 5]
