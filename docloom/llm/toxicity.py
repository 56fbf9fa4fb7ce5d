"""Toxicity: a convolutional text classifier in numpy.

Each word is the sum of hashed embeddings of itself and its prefixes; filters of
widths 1, 2 and 3 slide over the words, are rectified and max-pooled over the
whole text, and a linear layer gives a logit.  Trained by Adam with hand-written
gradients (the max lets only the winning window learn).  Thresholds are
calibrated by language, guessed from the text, on a fold that did not train;
each language's logits are shifted so that its threshold has score 0.3.

On executors a bounded memo keeps, per distinct word, its product with every
filter position, so scoring gathers rows instead of multiplying.  Words that the
memo lacks are hashed side by side, for as many texts at once as have ``STEP``
words together: most distinct words of a large corpus are rare, so the memo
misses about every fifth word.

Defined cases: null and empty texts have one padding word and get a score;
repeated rows get equal scores; with no labels of both classes the score is the
base rate; rows of null ``doc_id`` are scored and not held out; an empty table
gives no rows; other columns are ignored (:func:`keep_clean` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import learning, shared

BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
SAMPLE = 5000
EPOCHS = 4
AT = 0.3
EDGES = ".,;:!?\"'()[]*#$%&|"


def pieces(word: bytes) -> list[int]:
    """Hashed buckets of a word and its prefixes (bucket 0 is padding)."""
    text = word.decode("utf-8", "replace").strip(EDGES)
    if not text:
        return []
    keys = [f"w{text}"] + [f"p{text[:n]}" for n in PREFIXES if len(text) > n]
    return [1 + xxhash.xxh64_intdigest(k) % (BUCKETS - 1) for k in keys]


SLOTS = 1 + len(PREFIXES)
STEP = 20_000


def _padded(word: bytes) -> list[int]:
    p = pieces(word)
    return p + [0] * (SLOTS - len(p))


def padded(words: list[bytes]) -> np.ndarray:
    """Row k is ``_padded(words[k])``; one pass of hashing a slot, not a word."""
    texts = [w.strip(EDGES.encode()) for w in words]
    try:
        b" ".join(texts).decode()
    except UnicodeDecodeError:
        texts = [t.decode("utf-8", "replace").encode() for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = np.zeros((len(texts), 32), np.uint8)
    keys[:, 1:] = np.array(texts, "S31").view(np.uint8).reshape(-1, 31)
    out = np.zeros((len(texts), SLOTS), np.int32)
    at = np.flatnonzero((size > 0) & (size < 31))
    keys[:, 0] = ord("w")
    out[at, 0] = 1 + shared.short_hashes(keys[at], size[at] + 1) % np.uint64(BUCKETS - 1)
    keys[:, 0] = ord("p")
    wide = np.flatnonzero((keys > 127).any(axis=1))  # a prefix of n signs has more than n bytes
    signs = ((keys[wide, 1:] & 0xC0) != 0x80).cumsum(axis=1, dtype=np.int8)
    for k, n in enumerate(PREFIXES, 1):
        cut = np.full(len(texts), n)
        cut[wide] = (signs <= n).sum(axis=1)
        at = at[cut[at] < size[at]]
        out[at, k] = 1 + shared.short_hashes(keys[at], cut[at] + 1) % np.uint64(BUCKETS - 1)
    for k in np.flatnonzero(size > 30):
        out[k] = _padded(words[k])
    return out


def featurize(text: str | None):
    """Distinct words' buckets, and the text as indexes into them."""
    words = shared.words_of(text)
    index: dict[bytes, int] = {}
    seq = [index.setdefault(w, len(index)) for w in words]
    table = np.array([_padded(w) for w in index], np.int32)
    return np.array(seq, np.int32).tobytes(), table.tobytes(), learning.language(words)


FEATURES = "seq binary, buckets binary, lang int"


class Model:
    def __init__(self, params: dict[str, np.ndarray], shifts: list[float], scale: float):
        self.p, self.shifts, self.scale = params, shifts, scale
        self.memo = None

    def __getstate__(self):
        return {"p": self.p, "shifts": self.shifts, "scale": self.scale, "memo": None}

    def _project(self, words: list[bytes]) -> np.ndarray:
        e = sum(self.p["E"].take(slot, axis=0) for slot in padded(words).T)
        return np.concatenate([e @ self.p[f"W{w}"][j] for w in WIDTHS for j in range(w)], axis=1)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        if self.memo is None:
            self.memo = learning.WordTable(self._project, FILTERS * sum(WIDTHS))
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)))
        parts: list[tuple[int, list[bytes]]] = []
        n = 0
        for k, words in enumerate(texts):
            for s in range(0, max(1, len(words)), STEP):
                part = words[max(0, s - max(WIDTHS) + 1) : s + STEP] or [b""]
                parts.append((k, part))
                n += len(part)
                if n >= STEP:
                    self._pool(parts, pooled)
                    parts, n = [], 0
        if parts:
            self._pool(parts, pooled)
        return np.array([row @ self.p["c"] for row in pooled]) + self.p["b"][0]

    def _pool(self, parts: list[tuple[int, list[bytes]]], pooled: np.ndarray) -> None:
        """Raises row k of ``pooled`` to the maxima of the parts of text k."""
        at = self.memo([w for _, part in parts for w in part])
        end = 0
        for k, part in parts:
            start, end = end, end + len(part)
            np.maximum(pooled[k], maxima(self.memo.table.take(at[start:end], axis=0), self.p), out=pooled[k])

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        shift = np.array([self.shifts[learning.language(t)] for t in texts])
        return learning.sigmoid(self.scale * (self.logits(texts) - shift) + np.log(AT / (1 - AT)))


def pool(rows: np.ndarray, p: dict[str, np.ndarray]):
    """Max over the text of each rectified filter, and where the max stands.
    ``rows`` holds, per word, its product with every filter position."""
    best, where, at = [], [], 0
    for w in WIDTHS:
        cols = [rows[:, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(w)]
        at += w * FILTERS
        n = len(rows) - w + 1
        if n > 0:
            y = sum(c[j : j + n] for j, c in enumerate(cols))
            k = y.argmax(axis=0)
            best.append(y[k, np.arange(FILTERS)] + p[f"d{w}"])
            where.append(k)
        else:
            best.append(np.full(FILTERS, -1.0))
            where.append(np.full(FILTERS, -1))
    return np.maximum(np.concatenate(best), 0), np.concatenate(where)


def maxima(rows: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The first result of :func:`pool`, without the places."""
    best, at = np.zeros(FILTERS * len(WIDTHS)), 0
    for a, w in enumerate(WIDTHS):
        n = len(rows) - w + 1
        if n > 0:
            y = sum(rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(w))
            best[a * FILTERS : (a + 1) * FILTERS] = y.max(axis=0) + p[f"d{w}"]
        at += w * FILTERS
    return np.maximum(best, 0)


def train(rows: list, prior: bool = True) -> Model:
    """Fit on ``rows(fold, y, seq, buckets, lang)``; ``prior``: start from the
    classes' log-odds instead of at random."""
    rng = np.random.default_rng(7)
    p = {"E": rng.normal(0, 0.1, (BUCKETS, DIM)), "c": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "b": np.zeros(1)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS))
        p[f"d{w}"] = np.zeros(FILTERS)
    data = []
    for r in rows:
        table = np.frombuffer(r.buckets, np.int32).reshape(-1, SLOTS) if r.buckets else np.zeros((1, SLOTS), np.int32)
        data.append((np.frombuffer(r.seq, np.int32) if r.seq else np.zeros(1, np.int32), table, float(r.y > 0), r.lang, r.fold))
    fit = [d for d in data if d[4] != learning.CALIBRATE]
    y = np.array([d[2] for d in fit])
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        p["c"][:] = 0
        p["b"][:] = np.log((rate + 0.01) / (1.01 - rate))
        return Model(p, [0.0] * len(learning.LANGUAGES), 1.0)
    if prior:
        _prior(p, fit, y)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    adam = learning.Adam({k: v for k, v in p.items() if k != "E"}, 0.01)
    seen = np.full(p["E"].shape, 1e-3)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(fit))
        for s in range(0, len(order), 32):
            _step(p, [fit[i] for i in order[s : s + 32]], weight[order[s : s + 32]], adam, seen)
    held = [d for d in data if d[4] == learning.CALIBRATE]
    model = Model(p, [0.0] * len(learning.LANGUAGES), 1.0)
    z = np.array([_forward(p, d)[0] for d in held])
    t = np.array([d[2] for d in held])
    lang = np.array([d[3] for d in held])
    all_cut = learning.best_threshold(z, t)
    for k in range(len(learning.LANGUAGES)):
        mine = lang == k
        n = min(t[mine].sum(), (1 - t[mine]).sum()) if mine.any() else 0
        own = learning.best_threshold(z[mine], t[mine]) if n else all_cut
        model.shifts[k] = float((n * own + 10 * all_cut) / (n + 10))
    return model


def _prior(p, fit, y):
    """First embedding axis starts at the shrunken log-odds of a bucket's
    presence in the two classes; filter 0 of width 1 starts by reading it."""
    ones, zeros = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d in fit:
        (ones if d[2] else zeros)[np.unique(d[1])] += 1
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((zeros + 0.5) / (len(y) - y.sum() + 1))
    seen = ones + zeros
    p["E"][:, 0] = np.clip(odds * seen / (seen + 4), -3, 3) / SLOTS
    p["E"][0] = 0
    for w in WIDTHS:
        p[f"W{w}"][:, 0, : FILTERS // 2] = 1.0 / w
    p["c"][: FILTERS // 2] = 0.5


def _rows(p, d):
    e = p["E"][d[1]].sum(axis=1)
    return e, np.concatenate([e @ p[f"W{w}"][j] for w in WIDTHS for j in range(w)], axis=1)


def _forward(p, d):
    e, proj = _rows(p, d)
    pooled, where = pool(proj[d[0]], p)
    return pooled @ p["c"] + p["b"][0], pooled, where, e


def _step(p, batch, weight, adam, seen):
    g = {k: np.zeros_like(v) for k, v in adam.p.items()}
    at, by = _gradients(p, batch, weight, g)
    for k in g:
        g[k] += 1e-4 * p[k]
    adam.step(g)
    order, starts, ids = learning.by_value(at)
    v = np.add.reduceat(by[order], starts, axis=0)
    v, ids = (v[1:], ids[1:]) if ids[0] == 0 else (v, ids)  # padding stays zero
    seen[ids] += v * v  # sparse Adagrad for the embeddings
    p["E"][ids] -= 0.02 * v / np.sqrt(seen[ids])


def _gradients(p, batch, weight, g):
    """Adds the mean loss's gradients to ``g``; those of the embeddings are
    returned as buckets (which may repeat) and their steps."""
    at, by = [np.zeros(1, np.int64)], [np.zeros((1, DIM))]
    for d, wt in zip(batch, weight):
        z, pooled, where, e = _forward(p, d)
        dz = wt * (learning.sigmoid(z) - d[2]) / len(batch)
        g["b"] += dz
        g["c"] += dz * pooled
        dp = dz * p["c"] * (pooled > 0)
        for a, w in enumerate(WIDTHS):
            f = np.flatnonzero(dp[a * FILTERS : (a + 1) * FILTERS])
            if not len(f):
                continue
            v = dp[a * FILTERS + f]
            g[f"d{w}"][f] += v
            for j in range(w):
                u = d[0][where[a * FILTERS + f] + j]
                g[f"W{w}"][j, :, f] += v[:, None] * e[u]
                at.append(d[1][u].ravel())
                by.append(np.repeat(v[:, None] * p[f"W{w}"][j, :, f], SLOTS, axis=0))
    return np.concatenate(at), np.concatenate(by)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    model = train(learning.labelled(docs, labels, "toxic", sample, featurize, FEATURES))
    return apply(docs, model, AT)


def apply(docs: DataFrame, model, at: float) -> DataFrame:
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared_model.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                z = m.scores([shared.words_of(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", learning.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    model = train(learning.labelled(docs, labels, "toxic", sample, featurize, FEATURES))
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                z = shared_model.value.scores([shared.words_of(t.as_py()) for t in part.column(at)])
                yield part.filter(pa.array(z < AT))

    return docs.mapInArrow(run, schema)
