"""Benchmark decontamination by BM25 search of every training passage.

Test items form an inverted index: per term its items with their BM25 weight,
scaled so that an item's own full text scores 1.  Items stand in blocks; a term
keeps the greatest weight in each block.  Each document is cut into overlapping
passages at least twice as long as the longest item of the index, so every copy
of an item lies whole in one passage.  A passage's terms first add up block
maxima (the bound of block-max WAND): blocks whose bound stays under the
threshold are skipped; terms of little weight ("weak" ones) are not walked but
enter the bound as a constant.  The items of the blocks left are scored exactly,
and all at or above the threshold are retrieved.  A retrieved pair counts as
contamination if at least ``OVERLAP`` of the item's 5-word shingles occur in the
passage, and both the item's question (its first half) and its answer (its
second half) are met by at least half of theirs.

Items are indexed in slices of one length class and at most ``WORDS`` words.  As
many slices as hold ``PASS`` words together are broadcast for one pass over the
documents, which splits each text into words once for all of them.  The
statistics (number of items, mean length, items of a term) are those of all
items, and passages are as long for all slices of a length class, so a score
does not depend on how the items are cut.

Defined cases: words are lower-cased and stripped of marks at both ends; null
and empty documents match nothing; items without words are ignored; an item of
null ``item_id`` counts like any other and is reported with that null; an item of
fewer than five words is one shingle; repeated items are one, items that share an
id but not the text are each searched; repeated documents are reported each.
Other columns are ignored by :func:`contaminated` and kept by :func:`keep_clean`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

K1, B = 1.5, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
HALF = 0.5
SHINGLE = 5
BLOCK = 4
#: Share of an item's weight that its weak terms may hold together.
WEAK = 0.2
#: Words of the items of one index, and of all indexes of one broadcast.
WORDS, PASS = 400_000, 1_600_000
MARKS = b".,;:!?\"'()[]{}*#$%&|-_"


def clean_words(text: str | None) -> list[bytes]:
    return [c for w in shared.words_of(text) if (c := w.strip(MARKS))]


class Index:
    """Inverted index of one slice of items.  ``stats`` has what holds beyond the
    slice: number of items, their mean length, the longest of the length class
    and the items of each of the slice's terms; by default the slice is all."""

    def __init__(self, items: list[tuple[int | None, str]], stats: tuple[int, float, int, dict[bytes, int]] | None = None):
        self.ids = [i for i, _ in items]
        texts = [clean_words(t) for _, t in items]
        self.vocab: dict[bytes, int] = {}
        self.seqs = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in t], np.int32) for t in texts]
        if stats is None:
            lengths = list(map(len, texts))
            stats = len(items), sum(lengths) / len(items), max(lengths), Counter(w for t in texts for w in set(t))
        n, mean, longest, places = stats
        self.span = max(16, longest)
        df = np.array([places[w] for w in self.vocab], np.float64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.terms, self.weights = [], []
        for s in self.seqs:
            t, tf = np.unique(s, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
            self.terms.append(t)
            self.weights.append(w / w.sum())
        self.slack = np.zeros(-(-len(items) // BLOCK))
        strong = []  # (term, block, weight) of all but the weak terms
        for i, (t, w) in enumerate(zip(self.terms, self.weights)):
            order = np.lexsort((t, -df[t]))  # the most common terms come first
            weak = np.cumsum(w[order]) <= WEAK
            self.slack[i // BLOCK] = max(self.slack[i // BLOCK], w[order[weak]].sum())
            rest = order[~weak]
            strong.append(np.stack([t[rest], np.full(len(rest), i // BLOCK), w[rest]]))
        term, block, weight = np.concatenate(strong, axis=1)
        key, place = np.unique(term * len(self.slack) + block, return_inverse=True)
        self.most = np.zeros(len(key))
        np.maximum.at(self.most, place, weight)
        self.block = (key % len(self.slack)).astype(np.int32)
        self.start = np.searchsorted(key // len(self.slack), np.arange(len(self.vocab) + 1))

    def prepare(self):
        """Worker side: memo from raw words to terms (-1: in no item)."""
        self.memo = shared.Cache(lambda w: self.vocab.get(c, -1) if (c := w.strip(MARKS)) else -2, 400_000)
        return self

    def search(self, text: str):
        """(item, score, overlap) of each contaminating item, best passage."""
        raw = shared.words_of(text)
        terms = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        return self.hits(terms[terms != -2])

    def hits(self, terms: np.ndarray):
        best: dict[int, tuple[float, float]] = {}
        for p, b in self._bound(terms):
            passage = terms[p * self.span : (p + 2) * self.span]
            present = np.zeros(len(self.vocab) + 1, bool)
            present[passage] = True
            grams = None
            for i in range(b * BLOCK, min(len(self.ids), (b + 1) * BLOCK)):
                score = float(self.weights[i][present[self.terms[i]]].sum())
                if score < THRESHOLD - 1e-9:
                    continue
                grams = grams if grams is not None else set(_shingles(passage.tolist()))
                overlap = self._verify(i, passage, grams)
                if overlap is not None and (score, overlap) > best.get(i, (-1, -1)):
                    best[i] = (score, overlap)
        return [(self.ids[i], s, o) for i, (s, o) in sorted(best.items())]

    def _bound(self, terms: np.ndarray):
        """(passage, block) pairs whose bound reaches the threshold."""
        n_blocks = len(self.slack)
        n_pass = max(1, -(-len(terms) // self.span))
        at = np.flatnonzero(terms >= 0)
        t = terms[at]
        size = self.start[t + 1] - self.start[t]
        at, t, size = at[size > 0], t[size > 0], size[size > 0]
        if not len(t):
            return []
        flat = np.repeat(self.start[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.repeat(at // self.span, size) * n_blocks + self.block[flat]
        if n_pass * n_blocks <= 1 << 22:
            own = np.bincount(key, self.most[flat], n_pass * n_blocks).reshape(n_pass, n_blocks)
            both = own + np.concatenate([own[1:], np.zeros((1, n_blocks))])
            p, b = np.nonzero(both + self.slack >= THRESHOLD - 1e-9)
            return zip(p.tolist(), b.tolist())
        key = np.concatenate([key, key - n_blocks])  # a stretch belongs to two passages
        most = np.tile(self.most[flat], 2)
        keys, inv = np.unique(key[key >= 0], return_inverse=True)
        total = np.bincount(inv, most[key >= 0])
        ok = total + self.slack[keys % n_blocks] >= THRESHOLD - 1e-9
        return [(int(k) // n_blocks, int(k) % n_blocks) for k in keys[ok]]

    def _verify(self, i: int, passage: np.ndarray, grams: set):
        s = self.seqs[i]
        if len(s) < SHINGLE:
            n = len(s)
            rows = np.lib.stride_tricks.sliding_window_view(passage, n) if len(passage) >= n else np.zeros((0, n))
            return 1.0 if (rows == s).all(axis=1).any() else None
        hit = [g in grams for g in _shingles(s.tolist())]
        half = (len(hit) + 1) // 2
        question, answer = hit[:half], hit[half:] or hit[:half]
        overlap = sum(hit) / len(hit)
        met = sum(question) / len(question) >= HALF and sum(answer) / len(answer) >= HALF
        return overlap if overlap >= OVERLAP and met else None


def _shingles(s: list[int]) -> list[tuple]:
    return list(zip(*(s[k:] for k in range(SHINGLE))))


class Pass:
    """The indexes of one pass over the documents: one vocabulary for all, and
    for each index the places of its own terms in it."""

    def __init__(self, indexes: list[Index]):
        self.indexes = indexes
        self.vocab: dict[bytes, int] = {}
        for ix in indexes:
            for w in ix.vocab:
                self.vocab.setdefault(w, len(self.vocab))
        self.own = []
        for ix in indexes:
            own = np.full(len(self.vocab) + 1, -1, np.int32)  # the last place is that of -1, in no item
            own[[self.vocab[w] for w in ix.vocab]] = np.arange(len(ix.vocab))
            self.own.append(own)
            ix.vocab = range(len(ix.vocab))  # only its size is needed from here on

    def prepare(self):
        self.memo = shared.Cache(lambda w: self.vocab.get(c, -1) if (c := w.strip(MARKS)) else -2, 400_000)
        return self

    def search(self, text: str):
        raw = shared.words_of(text)
        terms = np.fromiter(map(self.memo.__getitem__, raw), np.int64, len(raw))
        terms = terms[terms != -2]
        return [hit for ix, own in zip(self.indexes, self.own) for hit in ix.hits(own[terms])]


def _worded(batches):
    for b in batches:
        words = [clean_words(t.as_py()) for t in b.column(1)]
        cols = [*b.columns, pa.array(list(map(len, words)), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(cols, ["item_id", "text", "len", "n_words", "terms"])


def _indexes(benchmark: DataFrame):
    """Indexes of bounded slices of one length class each, one after another,
    each with its number of words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = F.greatest(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")), F.lit(32))
    items = items.distinct().withColumn("len", F.ceil(F.log2(words.cast("double"))).cast("int"))
    worded = items.mapInArrow(_worded, "item_id long, text string, len int, n_words long, terms array<binary>").where("n_words > 0")
    items = shared.materialize(worded, "benchmark-items")
    places = shared.materialize(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "benchmark-terms")
    classes = sorted(items.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest")).collect())
    n = sum(r.n for r in classes)
    for r in classes:
        parts = -(-r.words // WORDS)
        for k in range(parts):
            part = items.where((F.col("len") == r.len) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k))
            got = part.select("item_id", "text", "n_words").collect()
            got.sort(key=lambda x: (x.item_id is not None, x.item_id or 0, x.text))
            if got:
                own = places.join(part.select(F.explode("terms").alias("term")).distinct(), "term").collect()
                stats = n, sum(c.words for c in classes) / n, r.longest, {bytes(x.term): x.n for x in own}
                yield Index([(x.item_id, x.text) for x in got], stats), sum(x.n_words for x in got)
    shared.discard(items)
    shared.discard(places)


def _passes(benchmark: DataFrame):
    """Broadcasts of as many indexes as fit, each for one pass."""
    spark, held, words = benchmark.sparkSession, [], 0
    for index, n in _indexes(benchmark):
        if held and words + n > PASS:
            yield spark.sparkContext.broadcast(Pass(held))
            held, words = [], 0
        held.append(index)
        words += n
    if held:
        yield spark.sparkContext.broadcast(Pass(held))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, overlap``: documents that hold a test item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _passes(benchmark):

        def run(batches, index=index):
            ix = index.value.prepare()
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if t.is_valid for hit in ix.search(t.as_py())]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64())], ["doc_id", "item_id", "score", "overlap"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    at = docs.columns.index("text")
    for index in _passes(benchmark):

        def run(batches, index=index):
            ix = index.value.prepare()
            for b in batches:
                yield b.filter(pa.array([not (t.is_valid and ix.search(t.as_py())) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
