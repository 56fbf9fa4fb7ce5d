"""Registered model-backed and order-dependent queries; those without an oracle
are tested against brute force.  Models are the offline stand-ins."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docloom import models as M
from docloom.operators import accumulate, agent
from docloom.plans.layout import BOX, boxes
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

TERMS = {"manual": ["the of", "die ", " qui "], "customer": ["tion", "heit", "eux", "ción"], "purchase": ["ent", "ung", "ou"]}
ROUTER = M.CannedModel((("the", '{"intent": "manual", "confidence": 0.9}'), ("der", '```json\n{"intent": "customer_service", "confidence": 0.4}\n```')), "no idea")
PLANNER = M.CannedModel((("the", '{"evidence_sufficient": false, "queries": ["the of and", "in the", "the of and", "that", "with"]}'),), "done")
SELECTOR = M.CannedModel((("the", '{"selected_chunk_ids": ["7", "no such id", "11"]}'),), "cannot say")
WRITER = M.CannedModel((("the", "**See** <PIC> [证据 1]"),), "Nothing found.")


def _search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("manual"))
    corpus = accumulate.Corpus(docs)

    def search(queries):
        """Tasks that ask the same are searched for once."""
        asked = queries.select("task_id", "query").distinct()
        hits = corpus.best(asked.select("query").distinct(), 8, "query", "query", 6)
        return asked.join(accumulate.looked_up(hits, docs), "query").select("task_id", F.col("doc_id").alias("id"), "score", "text", "manual")

    return search


def _tasks(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return agent.routed(agent.tasks(items), ROUTER, **TERMS)


def _has(terms):
    return "(" + " OR ".join(f"contains(lower(query), '{t}')" for t in terms) + ")"


@query(rf"""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark),
s AS (SELECT *, trim(regexp_replace(trim(line), ',$', '')) AS t FROM l), u AS (SELECT *, trim(replace(CASE WHEN length(t) >= 2 AND t[1] = '"' AND t[-1] = '"' THEN substr(t, 2, length(t) - 2) ELSE t END, '""', '"')) AS query FROM s),
q AS (SELECT item_id AS question_id, query, row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS turn_index, count(*) OVER (PARTITION BY item_id) AS turn_total FROM u WHERE query <> ''),
m AS (SELECT *, CASE WHEN contains(query, 'the') THEN 'manual' WHEN contains(query, 'der') THEN 'customer_service' END AS intent, CASE WHEN contains(query, 'the') THEN 0.9 WHEN contains(query, 'der') THEN 0.4 ELSE 0 END AS conf,
  question_id < 64 OR ({_has(TERMS["customer"])} AND (NOT {_has(TERMS["manual"])} OR {_has(TERMS["purchase"])})) AS rule FROM q)
SELECT question_id || '-' || turn_index AS task_id, question_id, turn_index::INT AS turn_index, turn_total::INT AS turn_total, query,
CASE WHEN question_id < 64 OR intent IS NULL OR conf < 0.55 OR (rule AND intent <> 'customer_service') THEN CASE WHEN rule THEN 'customer_service' ELSE 'manual' END ELSE intent END AS sub_agent FROM m""")
def route_questions(spark, d):
    return _tasks(spark, d)


@query()
def agentic_qa(spark, d):
    """Plan, search twice at most, select, answer and roll up every benchmark
    text."""
    t = _tasks(spark, d)
    evidence = agent.selected(t, agent.gather(t, _search(spark, d), PLANNER), SELECTOR)
    return agent.results(t, agent.answers(t, evidence, WRITER))


@query("""SELECT item_id::VARCHAR AS chunk_id, CASE WHEN contains(text, 'the') THEN '[{"name":"A","type":"x","description":"d"},{"name":"b","type":"y","description":"e"}]' ELSE '[]' END AS entities,
CASE WHEN contains(text, 'the') THEN '[{"source":"A","target":"b","description":"","keywords":["related_to"],"weight":10.0}]' ELSE '[]' END AS relationships, CASE WHEN NOT contains(text, 'the') THEN 'no valid extraction in 2 attempts' END AS error FROM benchmark""")
def kg_extract(spark, d):
    """Entities and relationships of each benchmark text, with one retry."""
    reply = '{"entities": [{"name": "A", "type": "X", "description": "d"}, {"name": "b", "type": "Y", "description": "e"}], "relationships": [{"source": "a", "target": "B", "weight": 12}]}'
    model = M.CannedModel((("the", "Well: " + reply + " ok"),), "no json")
    got = M.knowledge(table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"), model)
    return got.withColumns({c: F.to_json(c) for c in ("entities", "relationships")})


@query("""SELECT doc_id, 'See <PIC> and <PIC><PIC>, Manual3_4x <PIC> own_9 ' || text AS text, 'own_9,vr_7,drill0_1,oven_2' AS image_ids FROM documents""")
def picture_tokens(spark, d):
    """Marks in front of texts that hold none: an open mark takes the next image
    at hand, which then is not looked for by name again."""
    text = F.concat(F.lit("See [PIC] and drill0_1oven_2, Manual3_4x <PIC:vr_7> own_9 "), "text")
    x = table(spark, d, "documents").select("doc_id", M.picture_tokens_column(text, F.array(F.lit("own_9"), F.lit("img_1"))).alias("p"))
    return x.select("doc_id", "p.text", F.array_join("p.image_ids", ",").alias("image_ids"))


@query()
def embed_documents(spark, d):
    x = M.embed(table(spark, d, "documents").select("doc_id", "text"), "text", "embedding", M.HashEmbedding())
    return x.select("doc_id", "embedding")


def _overlap(queries, texts):
    return [len(set(q.split()) & set(t.split())) + int(hashlib.md5(t.encode()).hexdigest()[:4], 16) / 1e6 for q, t in zip(queries, texts)]


@query()
def rerank_candidates(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = accumulate.Corpus(docs).best(items, 30, "item_id")
    x = accumulate.looked_up(top, docs.select("doc_id", "text")).join(items.select("item_id", F.col("text").alias("query")), "item_id")
    return M.rerank(x.select("item_id", "query", F.col("doc_id").alias("id"), "text"), "item_id", _overlap, 8).select("item_id", "id", "rerank_score", "rank")


@query(f"""WITH RECURSIVE {BOX}, o AS (SELECT id, page, (y0 + y1) / 2 AS m, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, id) AS k FROM box),
f AS (SELECT page, k, 0 AS rw, m AS total, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT f.page, o.k, CASE WHEN abs(o.m - total / n) > 6 THEN rw + 1 ELSE rw END, CASE WHEN abs(o.m - total / n) > 6 THEN o.m ELSE total + o.m END,
CASE WHEN abs(o.m - total / n) > 6 THEN 1 ELSE n + 1 END FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1) SELECT id, page, rw::INT AS "row" FROM f JOIN o USING (page, k)""")
def row_clusters(spark, d):
    return agent.row_clusters(boxes(spark, d).select("id", "page", "x0", "y0", "x1", "y1"), "page")


@query()
def fragment_groups(spark, d):
    x = boxes(spark, d).select("id", "page", "x0", "y0", "x1", "y1", F.when((F.col("x0") < 300) & (F.col("x1") > 300), 0).when(F.col("x0") + F.col("x1") < 600, -1).otherwise(1).alias("column"))
    return agent.fragment_groups(x, "page")
