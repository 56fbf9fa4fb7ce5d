"""The classifiers against plain forward passes and numeric gradients, on very
long texts, and the bounds of what a fit reads."""

import collections

import numpy as np
import pytest

from docloom.llm import learning, mil_quality, shared, toxicity

Row = collections.namedtuple("Row", "fold y seq buckets lang counts")


def toxic_rows(n, rng):
    out = []
    for k in range(n):
        y = k % 3 == 0
        words = [f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 30))] + ["very", "badword"] * y
        seq, table, lang = toxicity.featurize(" ".join(words))
        out.append(Row(k % 2, int(y), seq, table, lang, None))
    return out


def quality_rows(n, rng):
    out = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 200))] + ["##", "$$$"] * (10 * (k % 3 == 0))
        seq, table, counts = mil_quality.featurize(" ".join(words))
        out.append(Row(k % 2, int(k % 3 > 0), seq, table, None, counts))
    return out


def plain_toxicity(p, words):
    """Loops over filters, positions and taps."""
    e = [sum((p["E"][b] for b in toxicity._padded(w)), np.zeros(toxicity.DIM)) for w in words or [b""]]
    z = float(p["b"][0])
    for a, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max((sum(e[s + j] @ p[f"W{w}"][j][:, f] for j in range(w)) + p[f"d{w}"][f] for s in range(len(e) - w + 1)), default=-1.0)
            z += max(best, 0.0) * p["c"][a * toxicity.FILTERS + f]
    return z


def plain_quality(p, words):
    hs, es = [], []
    odd = [mil_quality.symbols(w) for w in words]
    for s in range(0, max(1, len(words)), mil_quality.PASSAGE):
        part = words[s : s + mil_quality.PASSAGE]
        x = np.mean([sum(p["E"][b] for b in mil_quality.buckets(w)) for w in part], axis=0) if part else np.zeros(mil_quality.DIM)
        same = sum(a == b for a, b in zip(part, part[1:]))
        n = len(part)
        more = [1 - len(set(part)) / n, same / (n - 1) if n > 1 else 0, sum(odd[s : s + n]) / n, n / mil_quality.PASSAGE, 0] if n else [0, 0, 0, 0, 1]
        h = np.tanh(np.append(x, more) @ p["A"] + p["a"])
        hs.append(h)
        es.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
    alpha = np.exp(es - np.max(es))
    return float((alpha / alpha.sum()) @ np.array(hs) @ p["c"] + p["b"][0])


def test_toxicity_scores_match_plain_loops(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.train(toxic_rows(60, rng))
    monkeypatch.setattr(toxicity, "STEP", 7)
    texts = [[], [b"one"], b"w1 w2 very badword w3".split(), [f"w{x}".encode() for x in rng.integers(0, 90, 100)]]
    assert np.allclose(model.logits(texts), [plain_toxicity(model.p, t) for t in texts], atol=1e-4)


def test_quality_scores_match_plain_loops():
    rng = np.random.default_rng(1)
    model = mil_quality.train(quality_rows(60, rng))
    texts = [[], [b"one"], b"w1 w2 ## $$$ w3".split(), [f"w{x}".encode() for x in rng.integers(0, 90, 500)]]
    assert np.allclose([model.logit(t) for t in texts], [plain_quality(model.p, t) for t in texts], atol=1e-4)


def numeric(loss, value, places, step=1e-6):
    out = []
    for at in places:
        was = value[at]
        value[at] = was + step
        up = loss()
        value[at] = was - step
        out.append((up - loss()) / (2 * step))
        value[at] = was
    return np.array(out)


def log_loss(z, y):
    return np.log1p(np.exp(-z if y else z))


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    p = {k: v.copy() for k, v in toxicity.train(toxic_rows(30, rng), prior=False).p.items()}
    batch = [(np.frombuffer(r.seq, np.int32), np.frombuffer(r.buckets, np.int32).reshape(-1, toxicity.SLOTS), float(r.y)) for r in toxic_rows(4, rng)]
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
    at, by = toxicity._gradients(p, batch, np.ones(4), g)
    ge = np.zeros_like(p["E"])
    np.add.at(ge, at, by)
    loss = lambda: np.mean([log_loss(toxicity._forward(p, d)[0], d[2]) for d in batch])
    for k, v in [*g.items(), ("E", ge)]:
        places = [tuple(x) for x in np.argwhere(v)[:: max(1, np.count_nonzero(v) // 12)]]
        if k == "E":
            places = [x for x in places if x[0]]
        assert np.allclose(numeric(loss, p[k], places), [v[x] for x in places], atol=1e-6), k


def test_quality_gradients():
    rng = np.random.default_rng(2)
    p = {k: v.copy() for k, v in mil_quality.train(quality_rows(30, rng)).p.items()}
    for r in quality_rows(4, rng):
        seq, table = np.frombuffer(r.seq, np.int32), np.frombuffer(r.buckets, np.int32).reshape(-1, mil_quality.SLOTS)
        d = (seq, table, np.frombuffer(r.counts).reshape(-1, mil_quality.COUNTS), float(r.y), 0, learning.by_value(seq), learning.by_value(table.ravel()))
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
        ids, by = mil_quality._gradients(p, d, 1.0, g)
        ge = np.zeros_like(p["E"])
        ge[ids] += by
        loss = lambda d=d: log_loss(mil_quality.forward(p, mil_quality._inputs(p, d))[0], d[3])
        for k, v in [*g.items(), ("E", ge)]:
            places = [tuple(x) for x in np.argwhere(v)[:: max(1, np.count_nonzero(v) // 12)]]
            assert np.allclose(numeric(loss, p[k], places), [v[x] for x in places], atol=1e-6), k


def test_very_long_texts_are_scored_whole():
    rng = np.random.default_rng(4)
    filler = [f"w{x}".encode() for x in rng.integers(0, 50, 50_000)]
    toxic = toxicity.train(toxic_rows(200, rng))
    tail = filler + b"very badword".split()
    with_tail, without = toxic.logits([tail, filler])
    assert np.isclose(with_tail, toxic.logits([tail[:]])[0]) and with_tail > without
    quality = mil_quality.train(quality_rows(60, rng))
    assert np.isclose(quality.logit(filler), plain_quality(quality.p, filler), atol=1e-4)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (mil_quality, "quality")])
def test_a_fit_reads_bounded_rows(spark, module, label):
    """One row an id however often it repeats, texts whole, and rows of null id
    are not held out."""
    rows = [(1, f"text {k % 7}") for k in range(500)] + [(3, "w " * 100_000), (4, "c"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1)], f"doc_id long, {label} int")
    got = learning.labelled(docs, labels, label, 3, module.featurize, module.FEATURES)
    assert len(got) == len({r.doc_id for r in got}) <= 3
    assert max((len(r.seq) // 4 for r in got if r.doc_id == 3), default=100_000) == 100_000
    held = {r.doc_id: r.held_out for r in module.score(docs, labels).collect()}
    assert held[None] is False and all(isinstance(h, bool) for h in held.values())

