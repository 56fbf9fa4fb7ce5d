"""What the two trained classifiers share: sample, word features, calibration.

Labels come only from rows outside the held-out fold, crc32 of the decimal
``doc_id`` modulo 4 not being 2; a null ``doc_id`` is never held out.  A model is
fitted on the texts of at most ``sample`` such ids, those of least hash (a
documented bound), one row an id: of rows that repeat an id, the text of least
hash.  Texts enter the fit whole, as four bytes a word and a row of buckets a
distinct word, so what reaches the driver is bounded by ``sample`` texts.  Of the sampled rows, those of remainder 1
only calibrate.  Conflicting repeated labels of one id count as their maximum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2
CALIBRATE = 1

#: Frequent function words that tell the four languages apart.
LANGUAGE_WORDS = {
    "en": "the and of to in is that it with for was are this by be on from which".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "le la les des et un une du en que qui dans pour est sur par pas avec au".split(),
    "es": "el los las del y en que un una por con para se no su es al lo como".split(),
}
LANGUAGES = sorted(LANGUAGE_WORDS)
_VOTE = {}
for _k, _l in enumerate(LANGUAGES):
    for _w in LANGUAGE_WORDS[_l]:
        _VOTE[_w.encode()] = _VOTE.get(_w.encode(), ()) + (_k,)


def language(words: list[bytes]) -> int:
    """Guess from the text alone; index into LANGUAGES (first on ties)."""
    votes = [0] * len(LANGUAGES)
    for w in words:
        for k in _VOTE.get(w, ()):
            votes[k] += 1
    return votes.index(max(votes))


def fold(column):
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(4))


def held_out(column):
    """Never null."""
    return F.coalesce(fold(column) == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, featurize, feature_schema: str) -> list:
    """Rows (fold, y, features) of the bounded sample; features are made on the
    executors.  ``featurize(text)`` returns a tuple for ``feature_schema``."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.where("doc_id is not null and y is not null").withColumn("fold", fold("doc_id")).where(F.col("fold") != HELD_OUT)
    ids = ids.groupBy("doc_id", "fold").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(ids, "doc_id").groupBy("doc_id", "fold", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("doc_id", "fold", "y", "t.text")

    def run(batches):
        for b in batches:
            feats = [featurize(t.as_py()) for t in b.column(3)]
            cols = [pa.array([f[i] for f in feats]) for i in range(len(feats[0]))] if feats else []
            if feats:
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names)
                yield out.cast(target) if hasattr(out, "cast") else out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"doc_id long, fold long, y int, {feature_schema}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    names = target.names
    got = rows.mapInArrow(run, schema).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return got


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        a = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= a * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Logit in the middle of the gap that gives the best F1 of class 1."""
    if not len(z) or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    pos = y.sum()
    tp = pos - np.concatenate([[0], np.cumsum(y)])
    predicted = len(y) - np.arange(len(y) + 1)
    f1 = 2 * tp / np.maximum(1, predicted + pos)
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    ok = np.concatenate([[True], z[1:] > z[:-1], [True]])
    best = f1[ok].max()
    top = cuts[ok & (f1 >= best - 1e-12)]
    return float(np.median(top))


def by_value(values: np.ndarray):
    """(order, starts, distinct): sorts ``values``; run k of the sorted ones, from
    starts[k], holds distinct[k].  For sums over equal values with reduceat."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(values) else np.zeros(0, np.int64)
    return order, starts, ranked[starts]


class WordTable:
    """Bounded memo of one float row per distinct word; misses of a chunk are
    made together by ``make(words) -> matrix``."""

    def __init__(self, make, width: int, limit: int = 150_000):
        self.make, self.limit = make, limit
        self.index: dict[bytes, int] = {}
        self.table = np.empty((limit, width), np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Row number of each word; rows stay valid until the next call."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[k] for k in missing))
            if len(self.index) + len(new) > self.limit:
                self.index.clear()
                new = list(dict.fromkeys(words))
                missing = range(len(words))
            base = len(self.index)
            self.table[base : base + len(new)] = self.make(new)
            self.index.update(zip(new, range(base, base + len(new))))
            for k in missing:
                at[k] = self.index[words[k]]
        return at
