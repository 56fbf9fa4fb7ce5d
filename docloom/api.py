"""Engine facade: ingest manuals and FAQs, index them, answer questions in batch.

Tables live as parquet below one root folder, so a build step can be repeated
alone and a reader needs nothing but the root:

    chunks   chunk_id, manual_id, section_path, text, image_ids   (a growing collection)
    lexicon  word, uses                       (words of unspaced script)
    index    a growing BM25 index of chunks
    vectors  chunk_id, embedding              (a growing collection)
    manifest what the index was built with
    faq      idx, question, answer, q_vec, a_vec
    answers  question_id, answer, image_ids, agent, route
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions import text as T
from docloom.operators import agent, chat, chunking, faq, fusion, segment, vector
from docloom.session import checkpoint, exists
from docloom.sources import tables
from docloom.sources.collection import Collection
from docloom.sources.term_index import TermIndex


@dataclass(frozen=True)
class Settings:
    vector_top_k: int = 50
    bm25_top_k: int = 50
    rerank_top_n: int = 8
    final_top_k: int = 6
    faq_top_k: int = 3
    chunk_chars: int = 0
    overlap_chars: int = 100

    def __post_init__(self):
        if min(self.vector_top_k, self.bm25_top_k, self.rerank_top_n, self.final_top_k, self.faq_top_k) < 0:
            raise ValueError("sizes must not be negative")
        if self.chunk_chars and not 0 <= self.overlap_chars < self.chunk_chars:
            raise ValueError("overlap_chars must be smaller than chunk_chars")


@dataclass
class Engine:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    embedding: M.EmbeddingModel = field(default_factory=M.HashEmbedding)
    router: M.TextModel = field(default_factory=M.CannedModel)
    planner: M.TextModel = field(default_factory=lambda: M.CannedModel((), "done"))
    rewriter: M.TextModel = field(default_factory=lambda: M.CannedModel((), "as they are"))
    decomposer: M.TextModel = field(default_factory=lambda: M.CannedModel((), "one piece"))
    selector: M.TextModel = field(default_factory=lambda: M.CannedModel((), "first ones"))
    writer: M.TextModel = field(default_factory=lambda: M.CannedModel((), "No model is configured."))
    analyst: M.TextModel | None = None
    translator: M.TextModel | None = None
    reranker: Callable[[list[str], list[str]], list[float]] | None = None
    words: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.table(name)

    @property
    def chunks(self) -> Collection:
        return Collection(self.spark, f"{self.root}/chunks", "chunk_id")

    @property
    def vectors(self) -> Collection:
        return Collection(self.spark, f"{self.root}/vectors", "chunk_id")

    @property
    def index(self) -> TermIndex:
        return TermIndex(self.spark, f"{self.root}/index", id_type="string")

    def _cut(self, path: str) -> DataFrame:
        """Sections by markdown headings, cut into windows if a size is set."""
        docs = tables.read_manuals(self.spark, path).select("path", "manual_id", T.normalize_lines(F.col("text")).alias("text"))
        lines = docs.select("path", "manual_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
        mark = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 1)
        head = F.when(mark != "", F.length(mark))
        lines = lines.withColumn("level", head).withColumn("title", F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1))
        lines = chunking.stacked_path(lines, "path", "n", "title", "level")
        w = Window.partitionBy("path").orderBy("n")
        lines = lines.withColumn("section", F.sum(F.when(F.col("level").isNull(), 0).otherwise(1)).over(w))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
        sec = lines.groupBy("path", "manual_id", "section").agg(F.min_by("section_path", "n").alias("section_path"), T.normalize_lines(body).alias("text")).where("text <> ''")
        sec = sec.withColumn("section_path", F.when(F.col("section") == 0, "未命名章节").otherwise(F.col("section_path"))).withColumn("image_ids", T.image_ids(F.col("text")))
        size = self.settings.chunk_chars
        cut = chunking.fixed_windows(F.col("text"), size, self.settings.overlap_chars) if size else F.array(F.struct(F.lit(0).alias("sub_index"), F.col("text").alias("text")))
        return sec.withColumn("w", F.explode(cut)).select(
            T.stable_id("chunk", F.col("path"), F.col("section"), F.col("w.sub_index"), F.col("w.text")).alias("chunk_id"), "manual_id", "section_path", F.col("w.text").alias("text"), "image_ids"
        )

    def ingest_manuals(self, path: str) -> DataFrame:
        """The manuals below ``path`` and no others."""
        self.chunks.replace(self._cut(path))
        return self.chunks.read()

    def _lexicon(self) -> DataFrame:
        return self.spark.read.schema("word string, uses long").parquet(f"{self.root}/lexicon")

    def _terms(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return segment.terms(rows, self._lexicon(), key, text)

    def _index(self, c: DataFrame) -> None:
        words = F.concat_ws(" ", "manual_id", "section_path", "text", F.array_join("image_ids", " "))
        self.index.add(self._terms(c.select("chunk_id", words.alias("text")), "chunk_id", "text"), "chunk_id", words_col="words")
        long = F.concat_ws("\n", "manual_id", "section_path", "text", F.concat(F.lit("图片:"), F.array_join("image_ids", ",")))
        self.vectors.upsert(M.embed(c.select("chunk_id", long.alias("text")), "text", "embedding", self.embedding).select("chunk_id", "embedding"))

    def build_index(self) -> None:
        """Words, postings and vectors of all chunks, from the start.  Words of
        unspaced script are mined from the chunks; ``words(word, uses)`` adds one's own."""
        c = self.chunks.read()
        lexicon = segment.mined(c)
        if self.words is not None:
            lexicon = segment.merged(lexicon, self.words)
        self._save(lexicon, "lexicon")
        if self.index.size():
            self.index.delete(self.index.documents().select(F.col("id").alias("chunk_id")), "chunk_id")
        self.vectors.replace(self.spark.createDataFrame([], "chunk_id string, embedding array<double>"))
        self._index(c)
        self.index.merge()
        self.vectors.merge()
        self._save(self.manifest().coalesce(1), "manifest")

    def update_manuals(self, path: str) -> DataFrame:
        """The manuals below ``path`` take the place of those of the same name; all
        others stay.  Only chunks that are new are cut into words and embedded."""
        new, old = checkpoint(self._cut(path)), self.chunks.read()
        gone = old.join(new.select("manual_id").distinct(), "manual_id", "left_semi").join(new, "chunk_id", "left_anti")
        return self._change(new.join(old, "chunk_id", "left_anti"), gone.select("chunk_id"))

    def remove_manuals(self, manuals: DataFrame) -> DataFrame:
        gone = self.chunks.read().join(manuals.select("manual_id").distinct(), "manual_id", "left_semi").select("chunk_id")
        return self._change(None, gone)

    def _change(self, fresh: DataFrame | None, gone: DataFrame) -> DataFrame:
        gone = checkpoint(gone)
        fresh = None if fresh is None else checkpoint(fresh)
        for c in (self.chunks, self.vectors):
            c.delete(gone)
        self.index.delete(gone, "chunk_id")
        if fresh is not None and not fresh.isEmpty():
            self.chunks.upsert(fresh)
            self._index(fresh)
        self._save(self.manifest().coalesce(1), "manifest")
        return self.chunks.read()

    def manifest(self) -> DataFrame:
        """One row: what an index must have been built with to be fresh."""
        s = self.settings
        facts = self.chunks.read().agg(F.count(F.lit(1)).alias("chunks"), F.bit_xor(F.xxhash64("chunk_id", "text")).alias("content"))
        return facts.select("*", F.lit(s.chunk_chars).alias("chunk_chars"), F.lit(s.overlap_chars).alias("overlap_chars"), F.lit(type(self.embedding).__name__).alias("embedding"))

    def fresh(self) -> bool:
        """Whether the index is of the chunks and settings as they are now."""
        if not exists(self.spark, f"{self.root}/manifest/_SUCCESS"):
            return False
        now = self.manifest()
        return tables.same_manifest(self.table("manifest"), now, now.columns).first().fresh

    def ingest_faq(self, path: str) -> DataFrame:
        f = M.embed(M.embed(tables.read_faq(self.spark, path), "question", "q_vec", self.embedding), "answer", "a_vec", self.embedding)
        return self._save(f, "faq")

    def _near(self, queries: DataFrame, key: str, corpus: DataFrame, ident: str, vec: str, k: int) -> DataFrame:
        """Vector top-k with keys of any type: numbers stand in for the ids."""
        q = checkpoint(M.embed(queries, "query", "embedding", self.embedding, "query").select(key, "embedding").withColumn("vec_id", F.monotonically_increasing_id()))
        c = checkpoint(corpus.select(ident, F.col(vec).alias("embedding")).withColumn("vec_id", F.monotonically_increasing_id()))
        hits = vector.top_k(q, c, k)
        return hits.join(q.select(F.col("vec_id").alias("query_id"), key), "query_id").join(c.select(F.col("vec_id").alias("id"), ident), "id").select(key, ident, "score", "rank")

    def search(self, queries: DataFrame, key: str = "task_id") -> DataFrame:
        """``queries(key, query)`` -> ``(key, id, score, text, manual)``: vector and BM25
        legs fused, filtered by the query's language, capped, and reranked if there
        is a reranker (its ``rerank_top_n`` best stay, by its scores).  Refused where
        the index is stale."""
        if not self.fresh():
            raise ValueError("the index is not of these chunks and settings: build_index or update_manuals")
        s = self.settings
        queries = checkpoint(queries.select(F.struct(key, "query").alias("item_id"), "query"))
        bm = self.index.search(self._terms(queries, "item_id", "query"), s.bm25_top_k, "item_id", words_col="words")
        legs = bm.select("item_id", "id", F.lit("bm25").alias("source"), F.lit(1).alias("list_no"), "rank", "score")
        near = self._near(queries, "item_id", self.vectors.read(), "chunk_id", "embedding", s.vector_top_k)
        legs = near.select("item_id", F.col("chunk_id").alias("id"), F.lit("vector").alias("source"), F.lit(0).alias("list_no"), "rank", "score").unionByName(legs)
        c = self.chunks.read().select(F.col("chunk_id").alias("id"), "text", F.col("manual_id").alias("manual"), T.language(F.col("manual_id")).alias("own"))
        asked, own = T.language(F.col("item_id.query")), F.when(F.col("own") == "zh", "zh").otherwise("en")
        f = fusion.rrf(legs, "item_id").join(c, "id").where((asked == "unknown") | (asked == own))
        w = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
        cap = max(8 * s.rerank_top_n, 30)
        f = f.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
        if self.reranker:
            f = M.rerank(f.withColumn("query", F.col("item_id.query")), "item_id", self.reranker, s.rerank_top_n).withColumn("score", F.col("rerank_score"))
        return f.select(F.col(f"item_id.{key}").alias(key), "id", "score", "text", "manual")

    def ask_faq(self, queries: DataFrame, key: str = "task_id") -> DataFrame:
        """The cascade's route, number and answer for ``queries(key, query)``."""
        f, k = self.table("faq"), self.settings.faq_top_k
        legs = [self._near(queries, key, f, "idx", v, k).withColumnRenamed("idx", "id") for v in ("q_vec", "a_vec")]
        got = faq.cascade(queries, *legs, key)
        return got.join(f.select(F.col("idx").alias("faq_id"), "answer"), "faq_id", "left")

    def answer(self, questions: DataFrame, **terms) -> DataFrame:
        """``questions(question_id, question)`` -> one answered row each."""
        t = checkpoint(agent.routed(agent.decomposed(questions, self.rewriter, self.decomposer), self.router, **terms))
        manual, customer = t.where("sub_agent = 'manual'"), t.where("sub_agent <> 'manual'")
        found = agent.answers(manual, agent.selected(manual, agent.gather(manual, self.search, self.planner), self.selector, most=self.settings.final_top_k), self.writer, self.settings.final_top_k)
        served = self.ask_faq(customer.select("task_id", "query"))
        unmet = customer.join(served.where("faq_id is null").select("task_id"), "task_id", "left_semi")
        direct = agent.answers(self._analysed(unmet), self._none(), self.writer)
        hit = served.where("faq_id is not null").select("task_id", "answer", F.array().cast("array<string>").alias("image_ids"))
        told = found.unionByName(hit).unionByName(direct)
        if self.translator:
            told = M.in_question_language(told.join(t.select("task_id", "query"), "task_id"), "query", "answer", self.translator).drop("query")
        return agent.results(t, told)

    def _analysed(self, customer: DataFrame) -> DataFrame:
        """Tasks whose writer also sees what the answer must cover."""
        if not self.analyst:
            return customer
        x = M.analyzed(customer, "query", "_a", self.analyst)
        notes = [F.concat(F.lit(f"{name}: "), F.array_join(f"_a.{c}", "; ")) for name, c in (("Parts", "sub_questions"), ("Needed", "required_info"), ("Risks", "risk_notes"))]
        return x.withColumn("query", F.concat_ws("\n", "query", F.concat(F.lit("Intent: "), "_a.main_intent"), *notes)).drop("_a")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "task_id string, id string, score double, text string, first_seq long")

    def answer_batch(self, csv: str, first: int | None = None, last: int | None = None, **terms) -> DataFrame:
        """Answer a CSV of questions; ids already in ``answers`` are not asked
        again, new rows are appended."""
        q = tables.id_range(tables.read_questions(self.spark, csv), "id", first, last).select(F.col("id").alias("question_id"), "question")
        try:
            q = tables.not_done(q, self.table("answers"), "question_id")
        except Exception as e:  # no answers yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        q = q.dropDuplicates(["question_id"])
        self.answer(q, **terms).write.mode("append").parquet(f"{self.root}/answers")
        return self.table("answers")


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """What a rewrite sees of each chat: the last user turns and what followed."""
    return chat.last_user_turns(messages, turns)
