"""Embedding whitening: streaming covariance, merged over partitions.

Every task reads its vectors one after another and keeps, by Welford's rank-one
update, their count, mean and sum of centred outer products, and beside these
exact integer sums.  Such states are merged by the parallel update formula, at
most ``FAN`` at a time in rounds, until one is left; only that one (a matrix of
the vectors' dimension) reaches the driver, where Householder reflections and
implicitly shifted QR steps give the eigenvectors.  Rows are then projected and
written, and a second pass of the same kind measures what the projections'
covariance is.

Entries are quantised, ``floor(1024 * c) + 100000``, so that sums are exact.

Defined cases: vectors that are null or hold null or non-finite entries give no
row and enter no fit; empty vectors have no component, so no row; vectors of
another length are a fit of their own; entries beyond 2**40 / 1024 count as that
bound; a component without variance (at most ``NO_VARIANCE`` of the trace) has a
null ``whitened`` and stays out of the identity check; a trace of zero gives a null
``explained``; a ``deviation`` beyond a long is null; null ids and repeated rows
stay; ties of eigenvalues are numbered as the solver leaves them; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import shared

COMPONENTS = 8
SCALE, SHIFT, BOUND = 1024.0, 100_000, 2.0**40
FAN = 16
NO_VARIANCE = 1e-12
#: Vectors that a task holds as a matrix at once.
STEP = 2048
_FLOATS = pa.list_(pa.float64())
STATE = pa.schema([("dim", pa.int32()), ("task", pa.int64()), ("n", pa.int64()), ("mean", _FLOATS), ("outer", _FLOATS), ("sums", pa.list_(pa.decimal128(38, 0)))])


class Moments:
    """Count, mean, centred outer products and exact sums of a stream."""

    def __init__(self, d: int):
        self.n, self.mean, self.outer, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, one per row; sums only where rows are integers."""
        step = np.empty_like(self.outer)
        for x in rows.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            np.multiply.outer(delta, x - self.mean, out=step)
            self.outer += step
        if rows.dtype.kind == "i":
            self.sums = [a + b for a, b in zip(self.sums, rows.sum(axis=0).tolist())]

    def merge(self, o: Moments) -> None:
        n = self.n + o.n
        if not o.n:
            return
        delta = o.mean - self.mean
        self.mean = self.mean + delta * (o.n / n)
        self.outer = self.outer + o.outer + np.outer(delta, delta) * (self.n * o.n / n)
        self.sums = [a + b for a, b in zip(self.sums, o.sums)]
        self.n = n

    def covariance(self) -> np.ndarray:
        c = self.outer / self.n
        return (c + c.T) / 2

    def row(self, dim: int, task: int) -> dict:
        return {"dim": dim, "task": task, "n": self.n, "mean": self.mean.tolist(), "outer": self.outer.ravel().tolist(), "sums": self.sums}

    @classmethod
    def of(cls, r) -> Moments:
        d = len(r["mean"])
        m = cls(d)
        m.n, m.mean, m.outer, m.sums = int(r["n"]), np.array(r["mean"], float), np.array(r["outer"], float).reshape(d, d), [int(s) for s in r["sums"]]
        return m


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric
    matrix: reduced to three diagonals by reflections, then QR steps with
    Wilkinson's shift until the outer diagonals vanish."""
    n = len(a)
    a, q = np.array(a, float), np.eye(n)
    nothing = 1e-20 * np.abs(a).max(initial=0.0)  # far below rounding; squares of less underflow
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = math.copysign(np.linalg.norm(x), -x[0])
        if abs(size) <= nothing:
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        x[0] -= size
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        p -= (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = size
        q[k + 1 :] -= 2 * np.outer(x, x @ q[k + 1 :])  # q holds the basis as rows
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    high = n - 1
    while high > 0:
        for k in range(high):
            if abs(e[k]) <= max(nothing, 2.3e-16 * (abs(d[k]) + abs(d[k + 1]))):
                e[k] = 0.0
        if not e[high - 1]:
            high -= 1
            continue
        low = high - 1
        while low and e[low - 1]:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, o, g = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * g, s * s * p - 2 * c * s * o + c * c * g
            e[k] = c * s * (g - p) + (c * c - s * s) * o
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-np.array(d), kind="stable")
    return np.array(d)[order], q[order]


def vectors(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix)`` for each length of usable vector in a batch."""
    n = len(column)
    lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    out = []
    for d in np.unique(lengths[usable]).tolist():
        at = np.arange(n)[usable & (lengths == d)]
        out += [(r, flat[(ends[r] - d)[:, None] + np.arange(d)]) for r in np.split(at, range(STEP, len(at), STEP))]
    return out


def quantised(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * v), -BOUND, BOUND).astype(np.int64) + SHIFT


def fit(rows: DataFrame, name: str, prepare=lambda v: v, dim: str | None = None) -> dict[int, Moments]:
    """Moments of the vectors of ``rows(v[, dim])``, by ``dim`` or by length."""
    has_dim = dim is not None

    def stream(batches):
        states: dict[int, Moments] = {}
        for b in batches:
            for at, v in vectors(b.column(0)):
                v = prepare(v)
                kinds = b.column(1).to_numpy()[at] if has_dim else np.full(len(at), v.shape[1])
                for k in np.unique(kinds).tolist():
                    states.setdefault(k, Moments(v.shape[1])).add(v[kinds == k])
        if states:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([m.row(k, task) for k, m in states.items()], STATE)

    def join(key, table):
        got = sorted(table.to_pylist(), key=lambda r: r["task"])
        first = Moments.of(got[0])
        for r in got[1:]:
            first.merge(Moments.of(r))
        return pa.Table.from_pylist([first.row(got[0]["dim"], got[0]["task"] // FAN)], STATE)

    schema = from_arrow_schema(STATE)
    columns = [F.col("v"), F.col(dim)] if has_dim else [F.col("v")]
    states = shared.materialize(rows.select(*columns).mapInArrow(stream, schema), name)
    tasks = (states.agg(F.max("task")).first()[0] or 0) + 1
    last = states
    while tasks > 1:
        last = last.withColumn("_g", F.floor(F.col("task") / FAN)).groupBy("dim", "_g").applyInArrow(join, schema)
        tasks = -(-tasks // FAN)
    out = {r["dim"]: Moments.of(r) for r in last.collect()}
    shared.discard(states)
    return out


class Whitener:
    """What rows of one length need: exact sums, leading components, their
    standard deviations and shares."""

    def __init__(self, m: Moments, components: int):
        values, rows = eigen(m.covariance())
        trace = float(np.trace(m.covariance()))
        self.n, self.k = m.n, min(components, len(values))
        self.sums = np.array([s % 2**64 for s in m.sums], np.uint64)
        self.mean = m.mean
        usable = int((values[: self.k] > NO_VARIANCE * trace).sum())
        self.basis, self.sd = rows[:usable].T.copy(), np.sqrt(values[:usable])
        self.explained = [max(0.0, float(v)) / trace for v in values[: self.k]] if trace > 0 else [None] * self.k

    def __call__(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """Exact deviations (None beyond a long) and whitened rows."""
        away = (x.astype(np.uint64) * np.uint64(self.n) - self.sums).view(np.int64)  # exact: wraps back below 2**63
        size = (away.astype(float) ** 2).sum(axis=1)
        deviation = (away * away).sum(axis=1).tolist()
        for i in np.flatnonzero(size > 9.2e18):
            exact = sum(a * a for a in away[i].tolist())
            deviation[i] = exact if exact < 2**63 else None
        return deviation, (away / self.n) @ self.basis / self.sd


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``:
    one row per usable vector and component."""
    spark = rows.sparkSession
    data = rows.select(F.col(vec_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("vec_id"))
    models = {k: Whitener(m, components) for k, m in fit(data, "whiten-fit", quantised).items()}
    known = spark.sparkContext.broadcast(models)
    schema = "vec_id long, dim int, deviation long, v array<double>"

    def project(batches):
        for b in batches:
            ids = b.column(1)
            for at, v in vectors(b.column(0)):
                deviation, w = known.value[v.shape[1]](quantised(v))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(np.full(len(at), v.shape[1], np.int32)), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "dim", "deviation", "v"]
                )

    done = shared.materialize(data.mapInArrow(project, schema), "whiten-rows")
    error = {k: float(np.abs(m.covariance() - np.eye(len(m.mean))).max()) for k, m in fit(done, "whiten-check", dim="dim").items()}
    facts = [(k, m.n, error.get(k), m.explained) for k, m in models.items()]  # one row per vector length
    facts = spark.createDataFrame(facts, "dim int, n long, identity_error double, shares array<double>")
    out = done.join(F.broadcast(facts), "dim").select("*", F.posexplode("shares").alias("_c", "explained"))
    return out.select("vec_id", (F.col("_c") + 1).alias("component"), "n", "deviation", F.get("v", F.col("_c")).alias("whitened"), "explained", "identity_error")
