"""Quality rules: decision lists learned from labelled text statistics.

Every text is reduced to counts (:data:`STATS`), and every feature is a quotient
of two of them.  From a bounded sample of labelled texts, sequential covering
grows a conjunction of thresholds for either class by information gain on two
thirds of the rows, prunes it from its end on the others, and takes the better of
the two; the rows it covers go, and so on.  The list comes out as one ordered
``CASE WHEN`` over the counts (:func:`verdict`), so it can be read, stored and
applied by Spark alone.

Labels are those of ``learning.labelled`` (never of the held-out fold, remainder
2; rows of remainder 1 prune).  Texts that the base rules refuse are not in the
fit, as the list never judges them.

Defined cases: null and empty texts have counts of zero and fail the base rules; a
text of fewer than three words has no window; a line counts as a repetition only
if it holds a word; null ids and repeated rows stay; without usable labels the
list is empty and keeps all; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import learning

#: Bound of labelled texts that a fit reads.
SAMPLE = 5000
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_distinct", "n_top", "n_long", "n_digits", "n_ended"]
#: Words of more bytes are long ones.
LONG = 30
#: Name, numerator, denominator (at least 1) of what conditions compare.
FEATURES = [
    ("words", "n_words", None),
    ("chars_a_word", "word_chars", "n_words"),
    ("symbols_a_word", "n_symbols", "n_words"),
    ("repeated_lines", "n_dup_lines", "n_lines"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("words_a_line", "n_words", "n_lines"),
    ("stop_words", "n_stop", "n_words"),
    ("distinct_words", "n_distinct", "n_words"),
    ("commonest_word", "n_top", "n_words"),
    ("long_words", "n_long", "n_words"),
    ("digits_a_char", "n_digits", "word_chars"),
    ("ended_lines", "n_ended", "n_lines"),
]
MOST_CONDITIONS, MOST_RULES = 4, 16
#: A rule is taken only if so large a share of what it covers is of its class.
PRECISION = 0.9
FEWEST_WORDS, MOST_REPEATED = 50, 50

_STOP = frozenset(w.encode() for words in learning.LANGUAGE_WORDS.values() for w in words)


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    keys, size = ids[:n], distinct
    for k in range(1, WINDOW):
        if size * distinct >= 1 << 62:  # renumber, so that keys stay exact
            named, keys = np.unique(keys, return_inverse=True)
            size = len(named)
        keys = keys * distinct + ids[k : n + k]
        size *= distinct
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids) + 1, np.int64)
    covered[:n] += twice
    covered[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`STATS` over the whole text."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    uses = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    stop = long = 0
    for w, n in zip(number, uses.tolist()):
        stop += n if w.lower() in _STOP else 0
        long += n if len(w) > LONG else 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ended = sum(x.rstrip(SPACES).endswith((".", "!", "?")) for x in lines)
    digits = sum(map(text.count, "0123456789"))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(ids, len(number)),
        len(lines), stop, len(number), int(uses.max(initial=0)), long, digits, ended,
    )


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts, one row per row of ``docs``."""

    def run(batches):
        for b in batches:
            table = np.array([statistics(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, table.T.copy())], ["doc_id", *STATS])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *STATS])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features(stats: np.ndarray) -> np.ndarray:
    """The quotients of :data:`FEATURES`, from rows of counts."""
    at = {c: stats[:, k].astype(float) for k, c in enumerate(STATS)}
    return np.stack([at[a] / (np.maximum(at[b], 1.0) if b else 1.0) for _, a, b in FEATURES], axis=1) if len(stats) else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    limit: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] >= self.limit) == self.above

    def column(self) -> Column:
        _, a, b = FEATURES[self.feature]
        value = F.col(a).cast("double") / (F.greatest(F.col(b), F.lit(1)).cast("double") if b else F.lit(1.0))
        return value >= F.lit(self.limit) if self.above else value < F.lit(self.limit)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>=' if self.above else '<'} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.covers(x)
        return out

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'drop'} if {' and '.join(map(str, self.conditions))}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool

    def keeps(self, stats: np.ndarray) -> np.ndarray:
        x, out = features(stats), np.full(len(stats), self.default)
        for r in reversed(self.rules):
            out[r.covers(x)] = r.keep
        return out

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "keep" if self.default else "drop"])


def verdict(rules: DecisionList) -> Column:
    """The list as an ordered conditional expression over the counts."""
    out = None
    for r in rules.rules:
        test = r.conditions[0].column()
        for c in r.conditions[1:]:
            test = test & c.column()
        out = F.when(test, r.keep) if out is None else out.when(test, r.keep)
    return F.lit(rules.default) if out is None else out.otherwise(rules.default)


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain towards ``y``."""
    pos, n = int(y.sum()), len(y)
    if not pos or pos == n:
        return 0.0, None
    before, best = np.log2(pos / n), (1e-9, None)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, hits = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below, total = hits[cut], cut + 1
        for above, p, t in ((False, below, total), (True, pos - below, n - total)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / t) - before)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(k, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def _grow(x: np.ndarray, y: np.ndarray) -> list[Condition]:
    out: list[Condition] = []
    rows = np.ones(len(y), bool)
    while len(out) < MOST_CONDITIONS:
        gain, c = _best(x[rows], y[rows])
        if c is None:
            break
        out.append(c)
        rows &= c.covers(x)
    return out


def _prune(conditions: list[Condition], x: np.ndarray, y: np.ndarray) -> list[Condition]:
    """The leading conditions that do best on rows not grown from."""
    worth = []
    for k in range(1, len(conditions) + 1):
        hit = Rule(tuple(conditions[:k]), True).covers(x)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        worth.append(((p - n) / (p + n) if p + n else -1.0, p, -k))
    return conditions[: -max(worth)[2]] if worth else []


def learn(stats: np.ndarray, keep: np.ndarray, prunes: np.ndarray) -> DecisionList:
    """Sequential covering.  ``keep`` is the class of each row, ``prunes`` marks
    the rows that only prune."""
    x, keep, prunes = features(stats), np.asarray(keep, bool), np.asarray(prunes, bool)
    rules: list[Rule] = []
    left = np.ones(len(keep), bool)
    while len(rules) < MOST_RULES and 0 < keep[left].sum() < left.sum():
        found = []
        for kind in (False, True):
            y = keep == kind
            grown = _prune(_grow(x[left & ~prunes], y[left & ~prunes]), x[left & prunes], y[left & prunes])
            if grown:
                rule = Rule(tuple(grown), kind)
                hit = rule.covers(x) & left
                p, t = int(y[hit].sum()), int(hit.sum())
                found.append(((p + 1) / (t + 2), p, kind, p >= PRECISION * t and t > 0, rule))
        found = [f for f in found if f[3]]
        if not found:
            break
        rule = max(found, key=lambda f: f[:3])[4]
        rules.append(rule)
        left &= ~rule.covers(x)
    rest = keep[left]
    return DecisionList(tuple(rules), bool(2 * rest.sum() >= len(rest)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DecisionList:
    got = learning.labelled(docs, labels, label, sample, statistics, ", ".join(f"{c} long" for c in STATS))
    stats = np.array([r[3:] for r in got], np.int64).reshape(-1, len(STATS))
    words, repeated = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
    judged = (words >= FEWEST_WORDS) & (100 * repeated <= MOST_REPEATED * words)
    y, fold = np.array([r.y for r in got], bool), np.array([r.fold for r in got], np.int64)
    return learn(stats[judged], y[judged], fold[judged] == learning.CALIBRATE)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept``."""
    failed = base_failed()
    return counted(docs).select("doc_id", *STATS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, train(docs, labels, sample=sample))
