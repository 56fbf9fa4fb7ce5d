"""A growing BM25 index on disk: immutable segments, tombstones, summable counts.

    commits/seq=n            kind, base, n, length, mean     (one row per change)
    docs/seq=n               id, shard, pos, dl, terms, lens, tf
    postings/seq=n/bucket=b  shard, term, at, tf             (blocks of one term in one shard: places, frequencies)
    terms/seq=n/bucket=b     term, df                        (what the change adds or takes away)
    gone/seq=n               id, of, shard, pos, dl          (rows of change ``of`` that are dead since)

A change writes its tables under the next number and its row in ``commits`` last, so
a change that breaks off is not seen and the next one writes over it.  How many
documents hold a term is the sum of what each change added or took away; how many
there are, their words and the mean idf stand in the last commit.  A merge writes
what lives as one segment, from which later changes go on.

Documents are numbered in shards of about ``accumulate.HELD`` postings, and a task
inverts its own shards: postings are not shuffled.  A search opens the buckets of its
terms only.  Their blocks meet by shard, together with the ids and lengths of the
documents that live there, and each shard is scored whole in memory for all queries
side by side; only what may be among a query's best leaves it.

Defined cases: a document without an id is refused; of rows that repeat an id within
one change the one of least hash counts; null texts count as empty; an index without
documents finds nothing; null queries have no terms; unknown ids delete nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import text as T
from docloom.operators import accumulate, lexical
from docloom.session import exists

#: Most entries of a block; tombstones whose places are sent to all tasks, four bytes each.
BLOCK, LISTED = 1 << 14, 1 << 24
_BLOCK = "shard long, term string, at binary, tf binary"


def _blocks(batches):
    """Blocks of rows ``shard, pos, terms, lens, tf``, sorted by shard."""
    own: list = []
    for b in batches:
        shards = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s == e:
                continue
            if own and own[-1].column(0)[0].as_py() != shards[s]:
                yield _inverted(own)
                own = []
            own.append(b.slice(s, e - s))
    if own:
        yield _inverted(own)


def _inverted(batches: list) -> pa.RecordBatch:
    got = [(accumulate.terms_of(b.column(2), b.column(3)), b.column(1).to_numpy(), accumulate.unpacked(b.column(4))[1]) for b in batches]
    code = pa.chunked_array([terms for (_, terms), _, _ in got], pa.string()).combine_chunks().dictionary_encode()
    at, tf = np.concatenate([np.repeat(pos, n) for (n, _), pos, _ in got]), np.concatenate([f for _, _, f in got])
    term = code.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term = term[order]
    runs = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
    sizes = np.diff(np.append(runs, len(term)))
    pieces = -(-sizes // BLOCK)  # of each run
    starts = np.repeat(runs, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * BLOCK
    ends = np.append(starts, len(term))
    cols = [pa.array(np.full(len(starts), batches[0].column(0)[0].as_py())), code.dictionary.take(pa.array(term[starts])), accumulate.packed(ends, at[order]), accumulate.packed(ends, tf[order])]
    return pa.RecordBatch.from_arrays(cols, ["shard", "term", "at", "tf"])


def _sifted(dead: dict, living: bool):
    """Rows ``seq, shard, pos, ...`` that are not, or are, at ``dead[seq, shard]``."""

    def run(batches):
        for b in batches:
            seq, shard, pos = (b.column(c).to_numpy() for c in ("seq", "shard", "pos"))
            own = np.zeros(len(pos), bool)
            cuts = np.flatnonzero(np.append(True, (seq[1:] != seq[:-1]) | (shard[1:] != shard[:-1]))[: len(pos)])
            for s, e in zip(cuts, [*cuts[1:], len(pos)]):
                own[s:e] = np.isin(pos[s:e], dead.get((seq[s], shard[s]), ()))
            yield b.filter(pa.array(own != living))

    return run


def _shards(asked: accumulate.Asked):
    """Scores of rows sorted by ``seq, shard``: documents ``id, pos, dl`` and, where
    ``term`` is not null, blocks."""

    def run(batches):
        seen = accumulate.Best(asked)
        for t in accumulate.whole(batches, ["seq", "shard"]):
            key = [t[c].to_numpy() for c in ("seq", "shard")]
            cuts = np.flatnonzero(np.append(True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
            for s, e in zip(cuts, [*cuts[1:], t.num_rows]):
                yield from _shard(seen, t.slice(s, e - s).combine_chunks())

    return run


def _shard(seen: accumulate.Best, t: pa.Table):
    docs, blocks = t.filter(pc.is_null(t["term"])).combine_chunks(), t.filter(pc.is_valid(t["term"])).combine_chunks()
    if not docs.num_rows or not blocks.num_rows:
        return
    ids, dl, pos = docs["id"].chunk(0), docs["dl"].to_numpy(), docs["pos"].to_numpy()
    n, at = accumulate.unpacked(blocks["at"].chunk(0))
    tf = accumulate.unpacked(blocks["tf"].chunk(0))[1]
    term = np.repeat(pc.index_in(blocks["term"].chunk(0), value_set=seen.asked.terms).to_numpy(), n)
    row = np.full(max(int(at.max()), int(pos.max())) + 1, -1)
    row[pos] = np.arange(len(pos))
    row = row[at]
    own = row >= 0  # others are dead
    yield from seen.feed(ids, row[own], term[own], tf[own], dl[row[own]])


@dataclass
class TermIndex:
    spark: SparkSession
    root: str
    buckets: int = 64
    id_type: str = "bigint"

    def _commits(self) -> list:
        path = f"{self.root}/commits"
        if not exists(self.spark, path):
            return []
        rows = self.spark.read.schema("kind string, base long, n long, length long, mean double, seq long").parquet(path)
        return sorted(rows.collect(), key=lambda r: r.seq)  # one row per change

    def _state(self) -> tuple[list[int], object]:
        """Numbers of the changes that count, and the last one's row."""
        commits = self._commits()
        return ([c.seq for c in commits if c.seq >= commits[-1].base], commits[-1]) if commits else ([], None)

    def _read(self, name: str, seqs: list[int], schema: str) -> DataFrame:
        kind = StructType.fromDDL(schema)
        paths = [p for p in (f"{self.root}/{name}/seq={n}" for n in seqs) if exists(self.spark, f"{p}/_SUCCESS")]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _postings(self, seqs: list[int]) -> DataFrame:
        return self._read("postings", seqs, f"{_BLOCK}, seq long, bucket int")

    def _docs(self, seqs: list[int]) -> DataFrame:
        return self._read("docs", seqs, f"{accumulate.row_type(self.id_type)}, seq long")

    def _terms(self, seqs: list[int]) -> DataFrame:
        return self._read("terms", seqs, "term string, df long, seq long, bucket int")

    def _gone(self, seqs: list[int]) -> DataFrame:
        return self._read("gone", seqs, f"id {self.id_type}, of long, shard long, pos int, dl long, seq long")

    def _alive(self, rows: DataFrame, seqs: list[int]) -> DataFrame:
        """``rows(id, seq, ...)`` without those of documents replaced or deleted since;
        of few columns, as it may move them."""
        return self._apart(rows, self._gone(seqs), "left_anti") if len(seqs) > 1 else rows

    def _apart(self, rows: DataFrame, gone: DataFrame, how: str) -> DataFrame:
        gone = gone.select(F.col("id").alias("_gone"), "of")
        return rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("of") == F.col("seq")), how)

    def _whole(self, seqs: list[int], gone: DataFrame, living: bool) -> DataFrame:
        """Whole rows that are not, or are, among ``gone``.  Its places go to the rows,
        not these to it, as long as there are few enough."""
        rows = self._docs(seqs)
        if gone.count() > LISTED:
            return self._apart(rows, gone, "left_anti" if living else "left_semi")
        t = gone.groupBy("of", "shard").agg(F.collect_list("pos").alias("pos")).toArrow()
        dead = dict(zip(zip(t["of"].to_pylist(), t["shard"].to_pylist()), (x.values.to_numpy() for x in t["pos"])))
        return rows.mapInArrow(_sifted(dead, living), rows.schema)

    def documents(self) -> DataFrame:
        """``(id, dl)`` of what is in."""
        seqs, _ = self._state()
        return self._alive(self._docs(seqs), seqs).select("id", "dl")

    def size(self) -> int:
        _, last = self._state()
        return last.n if last else 0

    def _write(self, df: DataFrame, name: str, seq: int, by_bucket: bool = False) -> None:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy("bucket") if by_bucket else w).parquet(f"{self.root}/{name}/seq={seq}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _segment(self, rows: DataFrame, seq: int) -> tuple[DataFrame, object]:
        """Rows of documents as a segment: kept, and inverted shard by shard where
        they are."""
        self._write(rows, "docs", seq)
        docs = self._docs([seq])
        size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        blocks = docs.select("shard", "pos", "terms", "lens", "tf").mapInArrow(_blocks, _BLOCK)
        self._write(blocks.withColumn("bucket", self._bucket()), "postings", seq, True)
        return accumulate.frequencies(docs), size

    def _commit(self, seq: int, kind: str, base: int, n: int, length: int, counts: DataFrame, seqs: list[int]) -> int:
        self._write(counts.withColumn("bucket", self._bucket()).repartitionByRange("bucket", "term"), "terms", seq, True)
        known = self._terms([*seqs, seq]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        mean = lexical.mean_idf(known.select(lexical.raw_idf(F.lit(n), F.col("df")).alias("raw"))).first().mean
        row = self.spark.createDataFrame([(kind, base, n, length, mean)], "kind string, base long, n long, length long, mean double")
        self._write(row.coalesce(1), "commits", seq)
        return seq

    def _bury(self, ids: DataFrame, seq: int, seqs: list[int]) -> tuple[DataFrame, object]:
        """Tombstones for ``ids(id)``; what their dead rows take away."""
        alive = self._alive(self._docs(seqs).select("id", "seq", "shard", "pos", "dl"), seqs)
        self._write(alive.join(ids.distinct(), "id", "left_semi").select("id", F.col("seq").alias("of"), "shard", "pos", "dl"), "gone", seq)
        dead = self._gone([seq])
        size = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return accumulate.frequencies(self._whole(seqs, dead, False)).withColumn("df", -F.col("df")), size

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None) -> int:
        """Documents come in; those that bear a known id replace it.  ``words_col``
        names an array of words; else texts are cut by ``text.tokens``."""
        words = F.col(words_col) if words_col else accumulate.bare(F.col(text_col).cast("string"))
        refused = F.raise_error(F.lit("a document without an id")).cast(self.id_type)
        own = docs.select(F.coalesce(F.col(id_col).cast(self.id_type), refused).alias("id"), words.alias("words"))
        twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
        if not twice.isEmpty():  # else no text is moved
            listed = F.col("words") if words_col else T.tokens(F.col("words"))
            listed = F.coalesce(listed, F.array().cast("array<string>"))
            one = own.join(twice, "id", "left_semi").groupBy("id").agg(F.min_by("words", F.xxhash64(listed)).alias("words"))
            own = own.join(twice, "id", "left_anti").unionByName(one)
        seqs, last = self._state()
        seq = last.seq + 1 if last else 0
        counts, came = self._segment(accumulate.counted(own), seq)
        if not last:
            return self._commit(seq, "add", seq, came.n, came.length, counts, [])
        minus, went = self._bury(self._docs([seq]).select("id"), seq, seqs)
        both = counts.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df"))
        return self._commit(seq, "add", last.base, last.n + came.n - went.n, last.length + came.length - went.length, both, seqs)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        seqs, last = self._state()
        if not last:
            return -1
        seq = last.seq + 1
        minus, went = self._bury(ids.select(F.col(id_col).cast(self.id_type).alias("id")).where("id is not null"), seq, seqs)
        return self._commit(seq, "delete", last.base, last.n - went.n, last.length - went.length, minus, seqs)

    def merge(self) -> int:
        """What lives becomes one segment.  Older tables stay for readers that began
        before; nothing reads them afterwards."""
        seqs, last = self._state()
        if not last:
            return -1
        seq = last.seq + 1
        counts, size = self._segment(accumulate.dealt(self._whole(seqs, self._gone(seqs), True)), seq)
        return self._commit(seq, "merge", seq, size.n, size.length, counts, [])

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Blocks of the buckets of ``terms(term)``, of those terms."""
        seqs, _ = self._state()
        return self._buckets_of(self._postings(seqs), terms).join(terms.select("term").distinct(), "term", "left_semi")

    def _buckets_of(self, table: DataFrame, terms: DataFrame) -> DataFrame:
        """The partitions of ``table`` that hold the terms; at most ``buckets`` numbers."""
        used = [r.b for r in terms.select(self._bucket().alias("b")).distinct().collect()]
        return table.where(F.col("bucket").isin(used))

    def search(self, queries: DataFrame, k: int, query_id: str = "item_id", text_col: str = "text", words_col: str | None = None) -> DataFrame:
        """``(query, id, score, rank)``: the best k documents of every query, ties by
        id, of positive score."""
        seqs, last = self._state()
        words = F.col(words_col) if words_col else T.tokens(F.col(text_col))
        asked = queries.select(F.col(query_id).alias("query"), F.explode(words).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qf"))
        if not last or not last.n:
            return asked.select("query", F.lit(None).cast(self.id_type).alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).where("false").withColumnRenamed("query", query_id)
        df = self._buckets_of(self._terms(seqs), asked).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        asked = asked.join(df, "term").withColumn("idf", lexical.floored(lexical.raw_idf(F.lit(last.n), F.col("df")), F.lit(last.mean))).drop("df")
        docs = self._alive(self._docs(seqs).select("seq", "shard", "pos", "id", "dl"), seqs)

        def run(own: accumulate.Asked) -> DataFrame:
            terms = self.spark.createDataFrame(pa.table({"term": own.terms}), "term string")
            blocks = self._buckets_of(self._postings(seqs), terms).join(F.broadcast(terms), "term", "left_semi")
            rows = docs.unionByName(blocks.select("seq", "shard", "term", "at", "tf"), allowMissingColumns=True)
            placed = rows.repartition("seq", "shard").sortWithinPartitions("seq", "shard")
            return placed.mapInArrow(_shards(own), f"number long, id {self.id_type}, score double")

        hits = accumulate.best(asked, last.length / last.n, k, 9, run)
        return hits.select(F.col("query").alias(query_id), "id", "score", "rank")
