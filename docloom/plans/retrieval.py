"""Registered retrieval queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import fusion, lexical, vector
from docloom.plans.registry import register
from docloom.session import checkpoint, scratch, table
from docloom.sources.term_index import TermIndex

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)


TOKENS = r"list_filter(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"
POST = f"""
words AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
nd AS MATERIALIZED (SELECT count(*) AS n FROM documents),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
rawidf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, nd),
mr AS MATERIALIZED (SELECT sum(floor(raw * 1e12 + 0.5)::BIGINT)::DOUBLE / 1e12 / count(*) AS mean FROM rawidf),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM rawidf, mr)
"""
BM25 = POST + f""",
dl AS MATERIALIZED (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
avgdl AS MATERIALIZED (SELECT sum(dl) / (SELECT count(*) FROM documents) AS a FROM dl),
q AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark),
bm AS MATERIALIZED (SELECT item_id, doc_id, sum(floor(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) * 1e12 + 0.5)::BIGINT)::DOUBLE / 1e12 AS score
  FROM q JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), avgdl GROUP BY ALL)
"""
COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_terms, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"WITH {POST} SELECT doc_id, term, tf FROM post")
def bm25_postings(spark, d):
    return lexical.postings(table(spark, d, "documents"))


@query(f"WITH {POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    return lexical.idf(lexical.postings(docs), docs).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT item_id, doc_id, rank, round(round(score, 9), 5) AS score FROM r WHERE rank <= 50 AND score > 0""")
def bm25_topk(spark, d):
    s = lexical.scores(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumn("score", F.round("score", 9))
    return lexical.top_k(s, "item_id", 50).select("item_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT item_id, doc_id, rank, round(round(score, 9), 5) AS score FROM r WHERE rank <= 50 AND score > 0""")
def bm25_index_topk(spark, d):
    """The same hits from an index on disk, block by block."""
    with scratch(spark, "index") as root:
        index = TermIndex(spark, root)
        index.add(table(spark, d, "documents"))
        hits = index.search(table(spark, d, "benchmark"), 50)
        return checkpoint(hits.select("item_id", F.col("id").alias("doc_id"), "rank", F.round("score", 5).alias("score")))


@query(f"""WITH {BM25.replace("FROM documents", "FROM (SELECT * FROM documents WHERE source <> 'src3')")}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT item_id, doc_id, rank, round(round(score, 9), 5) AS score FROM r WHERE rank <= 50 AND score > 0""")
def bm25_index_update(spark, d):
    """An index that grew: English texts came in doubled first and were replaced, all
    others were added in a second change, one source was deleted, and all merged."""
    docs = table(spark, d, "documents")
    with scratch(spark, "index") as root:
        index = TermIndex(spark, root)
        english = docs.where("lang = 'en'")
        index.add(english.withColumn("text", F.concat_ws(" ", "text", "source", "text")))
        index.add(docs.where("lang <> 'en'"))
        index.add(english)
        index.delete(docs.where("source = 'src3'"))
        before = index.search(table(spark, d, "benchmark"), 50)
        index.merge()
        after = index.search(table(spark, d, "benchmark"), 50)
        hits = before.intersect(after)
        return checkpoint(hits.select("item_id", F.col("id").alias("doc_id"), "rank", F.round("score", 5).alias("score")))


@query(f"""WITH r AS (SELECT c.vec_id AS vec_id, {COS} AS s FROM embeddings q, embeddings c WHERE q.vec_id = 0)
SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, vec_id) AS rank FROM r QUALIFY rank <= 24""")
def vector_topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", vector.cosine("embedding", "q").alias("s"))
    best = s.orderBy(F.desc(F.round("s", 12)), "vec_id").limit(24)
    w = Window.orderBy(F.desc(F.round("s", 12)), "vec_id")
    return best.select("vec_id", F.round("s", 6).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"""WITH r AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {COS} AS s FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM r QUALIFY rank <= 10""")
def vector_topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    return vector.top_k(e.where("vec_id % 20 = 0"), e, 10).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("""SELECT q.vec_id, len(q.embedding) AS dim, round(sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS norm,
round(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS positive, round(list_inner_product(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 6) AS negative,
round(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) > round(list_inner_product(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 6) AS ranked
FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1 JOIN embeddings n ON n.vec_id = q.vec_id + 2""")
def embedding_check(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    n = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("n"))
    x = e.join(p, "vec_id").join(n, "vec_id")
    pos, neg = F.round(vector.dot("embedding", "p"), 6), F.round(vector.dot("embedding", "n"), 6)
    return x.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(vector.norm("embedding"), 6).alias("norm"), pos.alias("positive"), neg.alias("negative"), (pos > neg).alias("ranked"))


RANKED = """
v AS (SELECT source AS k, doc_id AS id, n_chars / 100.0 AS score, 0 AS list_no, 'vector' AS source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
b AS (SELECT source AS k, doc_id AS id, length(replace(text, ' ', '')) / 100.0 AS score, 1 AS list_no, 'bm25' AS source, row_number() OVER (PARTITION BY source ORDER BY length(replace(text, ' ', '')) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
u AS (SELECT * FROM v UNION ALL SELECT * FROM b)
"""


def _ranked_lists(spark, d):
    docs = table(spark, d, "documents")

    def ranked(score, name, no):
        w = Window.partitionBy("source").orderBy(F.desc(score), F.asc("doc_id"))
        r = docs.withColumn("rank", F.row_number().over(w)).where("rank <= 50")
        return r.select(F.col("source").alias("k"), F.col("doc_id").alias("id"), (score / 100.0).alias("score"), F.lit(no).alias("list_no"), F.lit(name).alias("source"), "rank")

    return ranked(F.col("n_chars"), "vector", 0).unionByName(ranked(F.length(F.replace("text", F.lit(" "), F.lit(""))), "bm25", 1))


@query(f"""WITH {RANKED} SELECT k, id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(source || ':' || printf('%.4f', score), ';' ORDER BY list_no) AS sources FROM u GROUP BY k, id""")
def rrf_fuse(spark, d):
    return fusion.rrf(_ranked_lists(spark, d), "k").withColumn("score", F.round("score", 9))


@query(f"""WITH {BM25}, b AS (SELECT item_id AS k, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, score FROM bm QUALIFY rank <= 50),
v AS (SELECT q.vec_id AS k, c.vec_id AS id, {COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vr AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY round(score, 12) DESC, id) AS rank FROM v QUALIFY rank <= 50),
f AS (SELECT k, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT k, id, rank FROM vr UNION ALL SELECT k, id, rank FROM b WHERE score > 0) GROUP BY k, id),
l AS (SELECT f.*, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS ql FROM f JOIN benchmark ON k = item_id),
k AS (SELECT l.k, l.id, l.score FROM l JOIN documents ON id = doc_id WHERE ql NOT IN ('zh', 'en') OR lang = ql),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS rank FROM k)
SELECT k AS item_id, id AS doc_id, score, rank FROM c WHERE rank <= 64""")
def hybrid_search(spark, d):
    """Vector and BM25 legs of 50, fused, filtered by the query's language after
    fusion, then capped at max(8 * top_n, 30) for top_n = 8."""
    docs, items, e = table(spark, d, "documents"), table(spark, d, "benchmark"), table(spark, d, "embeddings")
    s = lexical.scores(docs, items).withColumn("score", F.round("score", 9))
    b = lexical.top_k(s, "item_id", 50).select(F.col("item_id").alias("k"), F.col("doc_id").alias("id"), "rank", "score", F.lit(1).alias("list_no"), F.lit("bm25").alias("source"))
    q = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    v = vector.top_k(q, e, 50).select(F.col("query_id").alias("k"), "id", "rank", "score", F.lit(0).alias("list_no"), F.lit("vector").alias("source"))
    f = fusion.rrf(v.unionByName(b), "k").select("k", "id", F.round("score", 9).alias("score"))
    f = f.join(items.select(F.col("item_id").alias("k"), T.language(F.col("text")).alias("ql")), "k")
    f = f.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("ql not in ('zh', 'en') or lang = ql")
    w = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    return f.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 64").select(F.col("k").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query("SELECT doc_id, CASE WHEN regexp_matches(source || ' ' || lang, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS chunk_lang, n_chars FROM documents WHERE NOT regexp_matches(source || ' ' || lang, '[\\x{4e00}-\\x{9fff}]')")
def lang_filter(spark, d):
    own = F.concat_ws(" ", "source", "lang")
    lang = F.when(own.rlike(T.CJK), "zh").otherwise("en")
    return table(spark, d, "documents").select("doc_id", lang.alias("chunk_lang"), "n_chars").where("chunk_lang = 'en'")


HITS = """h AS (SELECT doc_id % 500 AS id, n_chars % 97 AS score, doc_id AS seq, source AS manual FROM documents)"""


def _hits(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 500).alias("id"), (F.col("n_chars") % 97).alias("score"), F.col("doc_id").alias("seq"), F.col("source").alias("manual"))


@query(f"""WITH {HITS} SELECT id, score, seq, manual, first_seq FROM (SELECT *, min(seq) OVER (PARTITION BY id) AS first_seq, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS rn FROM h) WHERE rn = 1""")
def dedupe_keep_best(spark, d):
    return fusion.keep_best(_hits(spark, d), "id", "score", "seq")


@query(f"""WITH {HITS}, c AS (SELECT seq % 50 AS k, seq AS id, manual, row_number() OVER (PARTITION BY seq % 50 ORDER BY score DESC, seq) AS rank, score > 90 AS chosen FROM h),
x AS (SELECT *, bool_or(chosen) OVER (PARTITION BY k) AS anyc, bool_or(chosen) OVER (PARTITION BY k, manual) AS same, count(*) OVER (PARTITION BY k) AS n, count(*) FILTER (chosen) OVER (PARTITION BY k) AS have FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY chosen DESC, rank) AS rn FROM x WHERE chosen OR same OR NOT anyc)
SELECT k, id, manual, rank, chosen FROM y WHERE rn <= greatest(have, least(4, n, 6))""")
def evidence_fill(spark, d):
    w = Window.partitionBy("k").orderBy(F.desc("score"), "seq")
    c = _hits(spark, d).withColumn("k", F.col("seq") % 50).withColumn("rank", F.row_number().over(w).cast("long"))
    return fusion.fill(c.select("k", F.col("seq").alias("id"), "manual", "rank", (F.col("score") > 90).alias("chosen")), "k", 4, 6)


@query("""WITH c AS (SELECT conv_id AS k, turn, unnest([conv_id * 7 % 1500, turn * 3, conv_id * 7 % 1500, conv_id + turn]) AS id, generate_subscripts([1, 2, 3, 4], 1) - 1 AS pos FROM conversations WHERE role = 'user'),
f AS (SELECT k * 100 + turn AS k, id, min(pos) AS pos FROM c GROUP BY ALL), s AS (SELECT * FROM f WHERE id IN (SELECT doc_id FROM documents))
SELECT k, id, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS rank FROM s QUALIFY rank <= 2""")
def select_valid_ids(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    seven = F.col("conv_id") * 7 % 1500
    chosen = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.array(seven, F.col("turn") * 3, seven, F.col("conv_id") + F.col("turn")).alias("ids"))
    return fusion.valid_ids(chosen, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "k", 2).withColumns({c: F.col(c).cast("long") for c in ("pos", "rank")})
