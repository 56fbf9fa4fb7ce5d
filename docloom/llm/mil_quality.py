"""Quality: attention-based multiple-instance learning in numpy.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
from the mean of hashed word embeddings (the word's letters, its other
characters, and its shape) and a few counts (repeats, symbols, length), through
one tanh layer.  Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), is
learned from document labels alone; the weighted passage representation is
scored by a linear layer.  Trained by Adam with hand-written gradients; the
threshold is calibrated on a fold that did not train and put at score 0.7.

Defined cases: null and empty texts are one empty passage; repeated rows get
equal scores; without labels of both classes the score is the base rate; rows of
null ``doc_id`` are scored and not held out; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from docloom.llm import learning, shared, toxicity

BUCKETS = 1 << 14
DIM = 12
COUNTS = 5
HIDDEN = 16
GATE = 8
PASSAGE = 48
SAMPLE = 5000
EPOCHS = 6
AT = 0.7
SLOTS = 3
_LETTERS = re.compile(r"[^\W_]+")


def buckets(word: bytes) -> list[int]:
    """Hashed buckets of a word: letters, the rest, shape."""
    text = word.decode("utf-8", "replace")
    letters = "".join(_LETTERS.findall(text))
    rest = _LETTERS.sub("a", text)
    shape = f"{min(len(letters), 12)}:{min(len(text) - len(letters), 4)}"
    return [xxhash.xxh64_intdigest(k) % BUCKETS for k in (f"l{letters}", f"r{rest}", f"s{shape}")]


def symbols(word: bytes) -> float:
    text = word.decode("utf-8", "replace")
    return float(len(text) - sum(map(len, _LETTERS.findall(text))) > 1 or not any(c.isalnum() for c in text))


def counts_of(seq: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Per passage: share of repeated words, of words equal to the one before,
    of symbol words, fill, and a flag for a text without words."""
    n = max(1, -(-len(seq) // PASSAGE))
    out = np.zeros((n, COUNTS))
    if not len(seq):
        out[0, 4] = 1
        return out
    for k in range(n):
        part = seq[k * PASSAGE : (k + 1) * PASSAGE]
        out[k, 0] = 1 - len(set(part.tolist())) / len(part)
        out[k, 1] = (part[1:] == part[:-1]).mean() if len(part) > 1 else 0
        out[k, 2] = odd[k * PASSAGE : (k + 1) * PASSAGE].mean()
        out[k, 3] = len(part) / PASSAGE
    return out


def featurize(text: str | None):
    words = shared.words_of(text)
    index: dict[bytes, int] = {}
    seq = [index.setdefault(w, len(index)) for w in words]
    odd = np.array([symbols(w) for w in index])
    c = counts_of(np.array(seq, np.int64), odd[seq] if seq else odd)
    table = np.array([buckets(w) for w in index], np.int32)
    return np.array(seq, np.int32).tobytes(), table.tobytes(), c.tobytes()


FEATURES = "seq binary, buckets binary, counts binary"


def passage_means(rows: np.ndarray) -> np.ndarray:
    starts = np.arange(0, len(rows), PASSAGE)
    return np.add.reduceat(rows, starts, axis=0) / np.diff(np.append(starts, len(rows)))[:, None]


def forward(p, x):
    h = np.tanh(x @ p["A"] + p["a"])
    t, u = np.tanh(h @ p["V"]), learning.sigmoid(h @ p["U"])
    e = (t * u) @ p["w"]
    e = np.exp(e - e.max())
    alpha = e / e.sum()
    rep = alpha @ h
    return float(rep @ p["c"] + p["b"][0]), (h, t, u, alpha, rep)


class Model:
    def __init__(self, params, cut: float):
        self.p, self.cut, self.memo = params, cut, None

    def __getstate__(self):
        return {"p": self.p, "cut": self.cut, "memo": None}

    def _rows(self, words: list[bytes]) -> np.ndarray:
        e = self.p["E"][np.array([buckets(w) for w in words])].sum(axis=1)
        return np.concatenate([e, np.array([[symbols(w)] for w in words])], axis=1)

    def logit(self, words: list[bytes]) -> float:
        if self.memo is None:
            self.memo = learning.WordTable(self._rows, DIM + 1)
        xs = []
        step = PASSAGE * 400
        for s in range(0, len(words), step):
            at = self.memo(words[s : s + step])
            rows = self.memo.table[at]
            xs.append(np.concatenate([passage_means(rows[:, :DIM].astype(np.float64)), counts_of(at, rows[:, DIM])], axis=1))
        if not xs:
            xs = [np.concatenate([np.zeros((1, DIM)), counts_of(np.zeros(0, np.int64), np.zeros(0))], axis=1)]
        return forward(self.p, np.concatenate(xs))[0]

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        z = np.array([self.logit(t) for t in texts])
        return learning.sigmoid(z - self.cut + np.log(AT / (1 - AT)))


def train(rows: list) -> Model:
    """Fit on ``rows(fold, y, seq, buckets, counts)``."""
    rng = np.random.default_rng(11)
    p = {
        "E": rng.normal(0, 0.1, (BUCKETS, DIM)), "A": rng.normal(0, 0.4, (DIM + COUNTS, HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    }
    data = []
    for r in rows:
        table = np.frombuffer(r.buckets, np.int32).reshape(-1, SLOTS)
        seq = np.frombuffer(r.seq, np.int32)
        data.append((seq, table, np.frombuffer(r.counts).reshape(-1, COUNTS), float(r.y > 0), r.fold, learning.by_value(seq), learning.by_value(table.ravel())))
    fit = [d for d in data if d[4] != learning.CALIBRATE]
    y = np.array([d[3] for d in fit])
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        p["c"][:] = 0
        p["b"][:] = np.log((rate + 0.01) / (1.01 - rate))
        return Model(p, 0.0)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    adam = learning.Adam({k: v for k, v in p.items() if k != "E"}, 0.01)
    seen = np.full(BUCKETS, 1e-4)
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for s in range(0, len(order), 16):
            batch = order[s : s + 16]
            g = {k: np.zeros_like(v) for k, v in adam.p.items()}
            for i in batch:
                ids, by = _gradients(p, fit[i], weight[i] / len(batch), g)
                seen[ids] += (by * by).mean(axis=1)
                p["E"][ids] -= 0.02 * by / np.sqrt(seen[ids])[:, None]
            for k in g:
                g[k] += 1e-4 * p[k]
            adam.step(g)
    held = [d for d in data if d[4] == learning.CALIBRATE]
    z = np.array([forward(p, _inputs(p, d))[0] for d in held])
    t = np.array([d[3] for d in held])
    return Model(p, -learning.best_threshold(-z, 1 - t) if len(z) else 0.0)


def _inputs(p, d):
    if not len(d[0]):
        return np.concatenate([np.zeros((1, DIM)), d[2]], axis=1)
    e = p["E"][d[1]].sum(axis=1)
    return np.concatenate([passage_means(e[d[0]]), d[2]], axis=1)


def _gradients(p, d, wt, g):
    """Adds one document's gradients to ``g``; returns the buckets it touches
    and their embeddings' gradients."""
    x = _inputs(p, d)
    z, (h, t, u, alpha, rep) = forward(p, x)
    dz = wt * (learning.sigmoid(z) - d[3])
    g["b"] += dz
    g["c"] += dz * rep
    dalpha = h @ (dz * p["c"])
    de = alpha * (dalpha - alpha @ dalpha)
    gated = t * u
    g["w"] += de @ gated
    dg = de[:, None] * p["w"]
    dt, du = dg * u * (1 - t * t), dg * t * u * (1 - u)
    g["V"] += h.T @ dt
    g["U"] += h.T @ du
    dh = alpha[:, None] * (dz * p["c"]) + dt @ p["V"].T + du @ p["U"].T
    dx = dh * (1 - h * h)
    g["A"] += x.T @ dx
    g["a"] += dx.sum(axis=0)
    if not len(d[0]):
        return np.zeros(0, np.int64), np.zeros((0, DIM))
    per = dx @ p["A"][:DIM].T
    sizes = np.diff(np.append(np.arange(0, len(d[0]), PASSAGE), len(d[0])))
    (order, starts, _), (slots, first, ids) = d[5], d[6]
    words = np.add.reduceat(np.repeat(per / sizes[:, None], sizes, axis=0)[order], starts, axis=0)
    return ids, np.add.reduceat(words[slots // SLOTS], first, axis=0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    model = train(learning.labelled(docs, labels, "quality", sample, featurize, FEATURES))
    return toxicity.apply(docs, model, AT)
