"""Shared storage, word splitting and graph components for the llm operators.

Rules that all operators follow:

* Intermediate tables go to the folder that the session names in
  ``spark.checkpoint.dir`` (a store that every executor sees).  Where that
  setting is missing, a local master gets a folder of its own (unit tests), and
  a cluster an error.
* Tables that only a finished step read are deleted (:func:`discard`,
  :func:`scratch`); those that a returned DataFrame still reads stay.
* Nothing that grows with the corpus is collected to the driver.
* Words are the maximal runs outside ASCII white space of the text after
  lowering A-Z, so ``bytes.lower().split()`` gives exactly these words.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as a URI or path."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="docloom-"))
        root = _local_dir[0]
    return root.rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_root(spark)}/docloom/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Hadoop's names of stores that pyarrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(path: str):
    """pyarrow filesystem of a path or URI, and the path inside it."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]+):/+", path)
    if not m:
        return pafs.LocalFileSystem(), path
    if m[1].lower() == "file":
        return pafs.LocalFileSystem(), "/" + path[m.end() :]
    scheme = m[1].lower()
    return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + path[len(scheme) :])


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that were made inside, for steps whose result is
    written by then."""
    first = len(_made)
    yield
    for path in _made[first:]:
        delete(spark, path)
    del _made[first:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, keeps only the columns needed."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_docloom_path", None)
    if path:
        delete(df.sparkSession, path)
        _made.remove(path)


def text_key(docs: DataFrame):
    """Tells differing texts of one ``doc_id`` apart."""
    return F.xxhash64(docs["text"].cast("string"))


def one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each row of ``chosen(doc_id, tkey, n)``,
    where n is how many rows have that id and text.  Of several, the row of least
    hash over all columns stays, so a repeated run takes the same."""
    names = docs.columns
    c = chosen.select(F.col("doc_id").alias("_k0"), F.col("tkey").alias("_k1"), F.col("n").alias("_k2"))
    own = docs.select(F.struct(*[docs[x].alias(f"c{k}") for k, x in enumerate(names)]).alias("_r"), docs["doc_id"].cast("long").alias("_id"), text_key(docs).alias("_t"))
    rows = own.join(c, (F.col("_id") == F.col("_k0")) & (F.col("_t") == F.col("_k1")))
    many = rows.where("_k2 > 1").groupBy("_k0", "_k1").agg(F.min_by("_r", F.struct(F.xxhash64("_r"), F.hash("_r"))).alias("_r"))
    out = rows.where("_k2 = 1").select("_r").unionByName(many.select("_r"))
    return out.select(*[F.col(f"_r.c{k}").alias(x) for k, x in enumerate(names)])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Cache(dict):
    """Bounded memo ``key -> make(key)``; emptied when full, so that a worker's
    memory stays bounded whatever the vocabulary."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


_hashes = Cache(xxhash.xxh64_intdigest, 150_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit xxhash of each word (seed 0)."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def short_hashes(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit xxhash (seed 0) of ``keys[k, :size[k]]`` for each k; ``keys`` has 32
    bytes a row, ``size`` is at most 31.  Many short keys go faster side by side
    than through a call each."""
    if not len(keys):
        return np.zeros(0, np.uint64)
    h = size.astype(np.uint64) + _P5
    eights, fours, row = keys.view(np.uint64), keys.view(np.uint32), np.arange(len(keys))
    for i in range(int(size.max()) // 8):
        h = np.where(size >= 8 * i + 8, _rotated(h ^ (_rotated(eights[:, i] * _P2, 31) * _P1), 27) * _P1 + _P4, h)
    h = np.where(size & 4, _rotated(h ^ (fours[row, size // 8 * 2].astype(np.uint64) * _P1), 23) * _P2 + _P3, h)
    for i in range(3):
        h = np.where(size % 4 > i, _rotated(h ^ (keys[row, size // 4 * 4 + i].astype(np.uint64) * _P5), 11) * _P1, h)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Hashes of arbitrary word ranges from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.pw = powers(n + 1)
        self.inv = powers(n + 1, pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.pw[:n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix64(raw + (np.asarray(end) - np.asarray(start)).astype(np.uint64))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by randomised min-neighbour contraction.

    ``edges(a long, b long)`` -> ``(node long, root long)``: nodes share a root
    iff they are connected.  Each round maps every node to the neighbour of
    least pseudo-random priority (itself included) and rewrites the edges, which
    shrinks the graph by a constant factor in expectation, so rounds are
    logarithmic also for long chains.  All steps are aggregations and joins;
    each round's tables are written to the shared folder.  Null ends are
    ignored, self-loops keep their node.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a is not null and b is not null")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    maps: list[DataFrame] = []
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        salt = F.lit(len(maps))
        best = F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v").alias("v"))).alias("m")
        own = F.struct(F.xxhash64("u", salt).alias("h"), F.col("u").alias("v"))
        step = materialize(both.groupBy("u").agg(best).select("u", F.least("m", own)["v"].alias("p")), name)
        maps.append(step)
        a = step.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        rest = edges.join(a, "a").join(b, "b").where("pa <> pb")
        rest = materialize(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
        discard(edges)
        edges = rest
        if edges.isEmpty():
            discard(edges)
            break
    labels = maps.pop()
    while maps:
        step = maps.pop()
        later = labels.select(F.col("u").alias("p"), F.col("p").alias("q"))
        joined = materialize(step.join(later, "p", "left").select("u", F.coalesce("q", "p").alias("p")), name)
        discard(step)
        discard(labels)
        labels = joined
    return labels.select(F.col("u").alias("node"), F.col("p").alias("root"))


class Forest:
    """Union-find over small local ids; keeps only the edges that join trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def bucket_tiles(rows: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """Lay the members of each bucket out as tiles of bounded size.

    Buckets of one member vanish.  A bucket of more than ``chunk`` members is
    dealt at random into chunks, and every pair of chunks (and each chunk with
    itself) is one tile, so that no task holds a whole hot bucket, while all
    pairs of members meet in exactly one tile.  Adds ``ti``, ``tj`` (tile) and
    ``side`` (0: in chunk ti, 1: in chunk tj; 0 on diagonal tiles).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.ceil(F.col("_n") / chunk).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(77)), F.col("_c")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("_c") - 1),
        lambda o: F.struct(F.least("_own", o).alias("ti"), F.greatest("_own", o).alias("tj"), F.when(F.col("_own") <= o, 0).otherwise(1).alias("side")),
    )
    out = rows.join(sizes, keys).withColumn("_c", n).withColumn("_own", own).withColumn("_t", F.explode(tiles))
    return out.select(*rows.columns, "_t.ti", "_t.tj", "_t.side")


def runs(batches, keys: list[str]):
    """Join the Arrow batches of a partition sorted by ``keys`` and yield lists
    of whole runs: ``(table, starts)`` with run k at rows starts[k]:starts[k+1].
    A run that crosses batches is carried over."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        starts = _starts(t, keys)
        last = starts[-2]
        rest = t.slice(last)
        if last:
            yield t.slice(0, last), starts[:-1]
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _starts(t, keys):
    change = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        v = t[k].to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])
