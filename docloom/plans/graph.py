"""Registered graph and evidence queries over suppliers, parts and line items.

Nodes are ``S<suppkey>`` and ``P<partkey>``; an edge joins a supplier and a part
that share line items, its source ids are the order keys; chunks are orders.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import evidence as E
from docloom.operators import graph_search as G
from docloom.operators import vector
from docloom.plans.registry import register
from docloom.session import checkpoint, scratch, table, written

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)


EDGES = """
edges AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, count(*) AS weight, min(l_orderkey) AS seq,
  array_to_string(list_sort(list_distinct(list(l_orderkey))), '<SEP>') AS source_id FROM lineitem GROUP BY l_suppkey, l_partkey),
nodes AS (SELECT 'S' || s_suppkey AS node, s_name AS description, 'supplier' AS kind FROM supplier UNION ALL SELECT 'P' || p_partkey, p_name, 'part' FROM part)
"""


#: Line items of one part.
DEALT = 1 << 20


def _parts(l):
    """How many parts line items are dealt into: their number grows with them, so what
    a task holds does not."""
    return max(int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-l.count() // DEALT))


def _pairs(l):
    """Line items by supplier and part.  Nearly all pairs differ, so they are dealt first."""
    return l.repartition(_parts(l), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey")


def edges(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string")), E.SEP)
    g = _pairs(table(spark, d, "lineitem")).agg(F.count(F.lit(1)).alias("weight"), F.min("l_orderkey").alias("seq"), ids.alias("source_id"))
    return g.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("tgt"), "weight", "seq", "source_id")


def nodes(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_name").alias("description"), F.lit("supplier").alias("kind"))
    return s.unionByName(table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_name").alias("description"), F.lit("part").alias("kind")))


@query("""WITH h AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5)
SELECT l_suppkey, rank, o_orderkey, o_orderstatus, o_orderpriority FROM h JOIN orders ON o_orderkey = l_orderkey""")
def join_hits_inner(spark, d):
    """Hits keep their rank, records that are missing drop their hit."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    h = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
    return h.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_suppkey", "rank", "o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH {EDGES}, h AS (SELECT 'S' || (s_suppkey + 3) AS node, s_name AS own FROM supplier)
SELECT h.node, coalesce(nullif(description, ''), own) AS description, kind IS NOT NULL AS known FROM h LEFT JOIN nodes USING (node)""")
def join_left_coalesce(spark, d):
    h = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey") + 3).alias("node"), F.col("s_name").alias("own"))
    j = h.join(nodes(spark, d), "node", "left")
    return j.select("node", F.coalesce(F.nullif("description", F.lit("")), "own").alias("description"), F.col("kind").isNotNull().alias("known"))


@query(f"""WITH {EDGES}, h AS (SELECT 'P' || p_partkey AS src, 'S' || (p_partkey % 100) AS tgt FROM part)
SELECT h.src, h.tgt, weight, e.src AS edge_src FROM h LEFT JOIN edges e ON least(h.src, h.tgt) = least(e.src, e.tgt) AND greatest(h.src, h.tgt) = greatest(e.src, e.tgt)""")
def join_unordered_pair(spark, d):
    h = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("S"), F.col("p_partkey") % 100).alias("tgt"))
    e = edges(spark, d).select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "weight", F.col("src").alias("edge_src"))
    return h.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt")).join(e, ["a", "b"], "left").select("src", "tgt", "weight", "edge_src")


@query(f"""WITH {EDGES} SELECT src, tgt, o_orderkey, o_orderstatus FROM (SELECT src, tgt, unnest(string_split(source_id, '<SEP>'))::BIGINT AS k FROM edges) JOIN orders ON o_orderkey = k""")
def join_exploded_ids(spark, d):
    x = E.source_ids(edges(spark, d)).withColumn("o_orderkey", F.col("chunk_id").cast("long"))
    return x.join(table(spark, d, "orders"), "o_orderkey").select("src", "tgt", "o_orderkey", "o_orderstatus")


@query(f"""WITH {EDGES} SELECT e.src, e.tgt, a.kind AS src_kind, b.kind AS tgt_kind, e.weight FROM edges e JOIN nodes a ON lower(a.node) = lower(e.src) JOIN nodes b ON lower(b.node) = lower(e.tgt)""")
def join_two_endpoints(spark, d):
    n = nodes(spark, d)
    a = n.select(F.lower("node").alias("ka"), F.col("kind").alias("src_kind"))
    b = n.select(F.lower("node").alias("kb"), F.col("kind").alias("tgt_kind"))
    e, parts = edges(spark, d), _parts(table(spark, d, "lineitem"))
    e = e.repartition(parts, F.lower("src")).join(a, F.lower("src") == F.col("ka"))
    e = e.repartition(parts, F.lower("tgt")).join(b, F.lower("tgt") == F.col("kb"))
    return e.select("src", "tgt", "src_kind", "tgt_kind", "weight")


@query("""SELECT o_orderkey AS chunk_id, coalesce(l.n, 0) AS items, CASE WHEN l.n IS NOT NULL THEN 'text' WHEN c.c_custkey IS NOT NULL THEN 'item' ELSE 'none' END AS found, c_name AS owner
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN customer c ON c_custkey = o_custkey AND c_acctbal > 0""")
def resolve_sources(spark, d):
    """First matching source wins; unresolved ones keep nulls.  Orders stand for
    candidates; lines of more than 40 pieces for the text chunks that hold some
    of them, customers in credit for the content items that hold others."""
    l = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = table(spark, d, "orders").join(l, "o_orderkey", "left").join(c, "o_custkey", "left")
    found = F.when(F.col("n").isNotNull(), "text").when(F.col("c_name").isNotNull(), "item").otherwise("none")
    return j.select(F.col("o_orderkey").alias("chunk_id"), F.coalesce("n", F.lit(0)).alias("items"), found.alias("found"), F.col("c_name").alias("owner"))


CANDS = """
cand AS (SELECT l_orderkey AS id, round(l_discount * 10, 2) AS score, 'chunk_vector' AS channel, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_shipmode_stub AS record FROM (SELECT *, l_returnflag AS l_shipmode_stub FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT l_orderkey, round(l_tax * 10, 2), 'entity_source', 1000000000000000 + (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey, l_linestatus FROM lineitem WHERE l_linestatus = 'O')
"""


def _candidates(spark, d):
    l = table(spark, d, "lineitem")
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    a = l.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.round(F.col("l_discount") * 10, 2).alias("score"), F.lit("chunk_vector").alias("channel"), at.alias("seq"), F.col("l_returnflag").alias("record"))
    return a.unionByName(l.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"), F.round(F.col("l_tax") * 10, 2).alias("score"), F.lit("entity_source").alias("channel"), (at + 1000000000000000).alias("seq"), F.col("l_linestatus").alias("record")))


@query(f"WITH {CANDS} SELECT id, max(score) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, min(seq) AS first_seq, arg_min(record, seq) AS record FROM cand GROUP BY id")
def merge_chunk_candidates(spark, d):
    return E.merge(_candidates(spark, d), ["id"], first=["record"]).withColumn("channels", F.array_join("channels", ","))


@query("""WITH c AS (SELECT 'P' || l_partkey AS entity, round(l_discount * 10, 2) AS score, 'f' || l_returnflag AS channel, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_linestatus AS description, [l_suppkey, l_partkey % 7] AS sources FROM lineitem)
SELECT entity, max(score) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, min(seq) AS first_seq, arg_min(description, seq) AS description, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources FROM c GROUP BY entity""")
def merge_entity_candidates(spark, d):
    l = table(spark, d, "lineitem")
    c = l.select(F.concat(F.lit("P"), "l_partkey").alias("entity"), F.round(F.col("l_discount") * 10, 2).alias("score"), F.concat(F.lit("f"), "l_returnflag").alias("channel"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.col("l_linestatus").alias("description"), F.array("l_suppkey", F.col("l_partkey") % 7).alias("sources"))
    return E.merge(c, ["entity"], first=["description"], union=["sources"]).withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in ("channels", "sources")})


@query("""WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS t, round(l_tax * 10, 2) AS score, 'c' || l_linestatus AS channel, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem)
SELECT least(s, t) AS a, greatest(s, t) AS b, max(score) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, min(seq) AS first_seq, arg_min(s, seq) AS s FROM c GROUP BY 1, 2""")
def merge_rel_candidates(spark, d):
    """Undirected key; the first direction seen stays in the record."""
    l = table(spark, d, "lineitem")
    even, s, p = F.col("l_linenumber") % 2 == 0, F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    c = l.select(F.when(even, s).otherwise(p).alias("s"), F.when(even, p).otherwise(s).alias("t"), F.round(F.col("l_tax") * 10, 2).alias("score"), F.concat(F.lit("c"), "l_linestatus").alias("channel"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))
    c = c.withColumn("a", F.least("s", "t")).withColumn("b", F.greatest("s", "t"))
    return E.merge(c, ["a", "b"], first=["s"]).withColumn("channels", F.array_join("channels", ","))


SEEDS = """
ehits AS (SELECT 'S' || s_suppkey AS node, round((s_acctbal + 1000) / 11000, 4) AS score FROM supplier ORDER BY score DESC, node LIMIT 15),
rhits AS (SELECT src, tgt, seq, round(weight / 100.0, 4) AS score FROM edges ORDER BY score DESC, src, tgt LIMIT 15),
seeds AS (SELECT node, max(score) AS score FROM (SELECT node, score FROM ehits UNION ALL SELECT src, score FROM rhits UNION ALL SELECT tgt, score FROM rhits) GROUP BY node)
"""


def _entity_hits(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.round((F.col("s_acctbal") + 1000) / 11000, 4).alias("score"))
    return s.orderBy(F.desc("score"), "node").limit(15)


def _relation_hits(spark, d, e):
    return e.withColumn("score", F.round(F.col("weight") / 100.0, 4)).orderBy(F.desc("score"), "src", "tgt").limit(15)


def _seeds(hits, rels):
    a = hits.select("node", "score").unionByName(rels.select(F.col("src").alias("node"), "score")).unionByName(rels.select(F.col("tgt").alias("node"), "score"))
    return a.groupBy("node").agg(F.max("score").alias("score"))


@query(f"WITH {EDGES}, {SEEDS} SELECT node, score FROM seeds")
def graph_seeds(spark, d):
    return _seeds(_entity_hits(spark, d), _relation_hits(spark, d, edges(spark, d)))


EXPAND = """
both_ways AS (SELECT src AS node, tgt AS other, src, tgt, seq FROM edges UNION ALL SELECT tgt, src, src, tgt, seq FROM edges WHERE src <> tgt),
near AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq, other) AS rn FROM both_ways QUALIFY rn <= 20),
step1 AS (SELECT other AS node, src, tgt, s.score * 0.8 AS score FROM seeds s JOIN near n ON n.node = s.node)
"""


@query(f"""WITH {EDGES}, {SEEDS}, {EXPAND}, front AS (SELECT node, max(score) AS score FROM step1 WHERE node NOT IN (SELECT node FROM seeds) GROUP BY node),
step2 AS (SELECT other AS node, src, tgt, f.score * pow(0.8, 2) AS score FROM front f JOIN near n ON n.node = f.node)
SELECT node, src AS edge_src, tgt AS edge_tgt, round(max(score), 6) AS score, min(step) AS step FROM (SELECT *, 1 AS step FROM step1 UNION ALL SELECT *, 2 FROM step2) GROUP BY node, src, tgt""")
def graph_expand(spark, d):
    e = written(edges(spark, d).select("src", "tgt", "weight", "seq"), "edges")
    seeds = _seeds(_entity_hits(spark, d), _relation_hits(spark, d, e))
    x = E.expand(seeds, e, depth=2)
    return x.groupBy("node", "edge_src", "edge_tgt").agg(F.round(F.max("score"), 6).alias("score"), F.min("step").alias("step"))


RETRIEVE = f"""
chits AS (SELECT o_orderkey AS id, round(o_totalprice / 1000000, 4) AS score FROM orders ORDER BY score DESC, id LIMIT 24),
cands AS (
  SELECT id, score, 'chunk_vector' AS channel FROM chits
  UNION ALL SELECT l_orderkey, score * 0.9, 'entity_source' FROM ehits JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) ON node = 'S' || l_suppkey
  UNION ALL SELECT k::BIGINT, r.score * 0.85, 'relationship_source' FROM rhits r JOIN (SELECT src, tgt, unnest(string_split(source_id, '<SEP>')) AS k FROM edges) e ON e.src = r.src AND e.tgt = r.tgt
  UNION ALL SELECT k::BIGINT, s.score * 0.85, 'graph_source' FROM step1 s JOIN (SELECT src, tgt, unnest(string_split(source_id, '<SEP>')) AS k FROM edges) e ON e.src = s.src AND e.tgt = s.tgt)
"""


def _retrieve(spark, d):
    e = written(edges(spark, d), "edges")
    eh, rh = _entity_hits(spark, d), _relation_hits(spark, d, e)
    step1 = E.expand(_seeds(eh, rh), e, depth=1).select(F.col("edge_src").alias("src"), F.col("edge_tgt").alias("tgt"), "score")
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    c = o.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000000, 4).alias("score")).orderBy(F.desc("score"), "id").limit(24).withColumn("channel", F.lit("chunk_vector"))
    src = l.select(F.concat(F.lit("S"), "l_suppkey").alias("node"), F.col("l_orderkey").alias("id")).distinct()
    c = c.unionByName(eh.join(src, "node").select("id", (F.col("score") * E.ENTITY_WEIGHT).alias("score"), F.lit("entity_source").alias("channel")))
    for hits, name in ((rh.select("src", "tgt", "score"), "relationship_source"), (step1, "graph_source")):
        near = e.join(hits.select("src", "tgt", F.col("score")), ["src", "tgt"])
        c = c.unionByName(E.source_ids(near).select(F.col("chunk_id").cast("long").alias("id"), (F.col("score") * E.RELATION_WEIGHT).alias("score"), F.lit(name).alias("channel")))
    return c.withColumn("seq", F.lit(0))


@query(f"""WITH {EDGES}, {SEEDS}, {EXPAND}, {RETRIEVE}
SELECT id, round(max(score), 6) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM cands JOIN orders ON o_orderkey = id GROUP BY id ORDER BY round(max(score), 6) DESC, id LIMIT 8""")
def graph_retrieve(spark, d):
    """Four channels of evidence, merged by chunk, best eight."""
    m = E.merge(_retrieve(spark, d), ["id"]).withColumn("score", F.round("score", 6))
    m = m.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return m.orderBy(F.desc("score"), "id").limit(8).select("id", "score", F.array_join("channels", ",").alias("channels"))


@query(f"""WITH {EDGES}, {SEEDS}, {EXPAND}, {RETRIEVE}
SELECT o_custkey, id, round(max(score), 6) AS score, count(DISTINCT channel) AS n_channels FROM cands JOIN orders ON o_orderkey = id GROUP BY o_custkey, id""")
def retrieve_doc_scoped(spark, d):
    """Every customer is a scope: a filter after the top-k legs, so fewer rows
    may come back."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return _retrieve(spark, d).join(o, "id").groupBy("o_custkey", "id").agg(F.round(F.max("score"), 6).alias("score"), F.countDistinct("channel").alias("n_channels"))


WHOLE = """
ne AS (SELECT count(*) AS n FROM embeddings),
asked AS MATERIALIZED (SELECT item_id AS query, CASE WHEN item_id % 2 = 1 THEN 'N' || (item_id % 25) END AS scope FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)),
sim AS MATERIALIZED (SELECT query, c.vec_id AS v, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS s FROM asked JOIN embeddings q ON q.vec_id = query, embeddings c),
ge AS MATERIALIZED (SELECT src, tgt, seq, sources, least(src, tgt) || '|' || greatest(src, tgt) AS key FROM (
  SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, min(l_orderkey) AS seq, list_distinct(list(l_orderkey::VARCHAR)) AS sources FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, -s_suppkey, [] FROM supplier)),
gn AS MATERIALIZED (SELECT 'S' || s_suppkey AS name, false AS hub, coalesce(o, []) AS sources, s_suppkey * 10 + 1 AS id, s_suppkey AS n FROM supplier LEFT JOIN (SELECT l_suppkey, list_distinct(list(l_orderkey::VARCHAR)) AS o FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey
  UNION ALL SELECT 'P' || p_partkey, false, coalesce(o, []), p_partkey * 10 + 2, p_partkey FROM part LEFT JOIN (SELECT l_partkey, list_distinct(list(l_orderkey::VARCHAR)) AS o FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
  UNION ALL SELECT 'N' || n_nationkey, true, [], n_nationkey * 10 + 3, n_nationkey + 7 FROM nation),
gc AS MATERIALIZED (SELECT o_orderkey::VARCHAR AS chunk, 'N' || c_nationkey AS doc, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey),
corpus AS (SELECT 0 AS kind, chunk AS key, id, id % n AS v FROM gc, ne UNION ALL SELECT 1, name, id, gn.n % ne.n FROM gn, ne
  UNION ALL SELECT 2, key, seq * 1000000 + substr(tgt, 2)::BIGINT, (abs(seq) * 31 + substr(tgt, 2)::BIGINT) % n FROM ge, ne),
hits AS MATERIALIZED (SELECT query, scope, kind, key, s AS score FROM (SELECT query, kind, key, s, row_number() OVER (PARTITION BY query, kind ORDER BY s DESC, id) AS r FROM sim JOIN corpus USING (v)) JOIN asked USING (query) WHERE r <= [24, 15, 15][kind + 1]),
sn AS MATERIALIZED (SELECT name, hub, chunk, doc FROM (SELECT name, hub, unnest(sources) AS chunk FROM gn) JOIN gc USING (chunk)),
se AS MATERIALIZED (SELECT key, chunk, doc FROM (SELECT key, unnest(sources) AS chunk FROM ge) JOIN gc USING (chunk)),
ent AS MATERIALIZED (SELECT query, scope, key AS name, score FROM hits h WHERE kind = 1 AND (scope IS NULL OR ends_with(key, scope) OR EXISTS (SELECT 1 FROM sn WHERE sn.name = h.key AND doc = scope))),
rel AS MATERIALIZED (SELECT query, scope, key, score, src, tgt, sources FROM hits h JOIN ge USING (key) WHERE kind = 2 AND (scope IS NULL OR EXISTS (SELECT 1 FROM se WHERE se.key = h.key AND doc = scope))),
seed AS (SELECT query, scope, name, max(score) AS score FROM (SELECT query, scope, name, score FROM ent UNION ALL SELECT query, scope, src, score FROM rel UNION ALL SELECT query, scope, tgt, score FROM rel) GROUP BY ALL),
near AS MATERIALIZED (SELECT * FROM (SELECT src AS name, tgt AS other, key, seq, sources FROM ge UNION ALL SELECT tgt, src, key, seq, sources FROM ge WHERE src <> tgt) QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq, other) <= 20),
step AS MATERIALIZED (SELECT query, scope, other, near.key, sources, score * 0.8 AS score FROM seed JOIN near USING (name) WHERE scope IS NULL OR EXISTS (SELECT 1 FROM se WHERE se.key = near.key AND doc = scope)),
met AS MATERIALIZED (SELECT query, scope, other AS name, max(score) AS score FROM step GROUP BY ALL),
cand AS (
  SELECT query, 0 AS kind, key, score, 'chunk_vector' AS channel, CAST([] AS VARCHAR[]) AS sources FROM hits JOIN gc ON chunk = key WHERE kind = 0 AND (scope IS NULL OR doc = scope)
  UNION ALL SELECT query, 1, name, score, 'entity_vector', sources FROM ent JOIN gn USING (name)
  UNION ALL SELECT query, 0, chunk, score * 0.9, 'entity_source', [] FROM ent JOIN sn USING (name) WHERE NOT hub AND (scope IS NULL OR doc = scope)
  UNION ALL SELECT query, 2, key, score, 'relationship_vector', sources FROM rel
  UNION ALL SELECT query, 0, chunk, score * 0.85, 'relationship_source', [] FROM rel JOIN se USING (key) WHERE scope IS NULL OR doc = scope
  UNION ALL SELECT query, 2, key, score, 'graph_expand', sources FROM step
  UNION ALL SELECT query, 0, chunk, score * 0.85, 'graph_source', [] FROM step JOIN se USING (key) WHERE scope IS NULL OR doc = scope
  UNION ALL SELECT query, 1, name, score, 'graph_expand', sources FROM met JOIN gn USING (name)
  UNION ALL SELECT query, 0, chunk, score * 0.9, 'graph_source', [] FROM met JOIN sn USING (name) WHERE NOT hub AND (scope IS NULL OR doc = scope)),
one AS (SELECT query, kind, key, round(max(score), 9) AS score, list_sort(list_distinct(list(channel))) AS channels, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM cand GROUP BY query, kind, key)
"""


@query(f"""WITH {WHOLE} SELECT query, kind, key, round(score, 6) AS score, array_to_string(channels, ',') AS channels, md5(array_to_string(sources, ',')) AS sources, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, key) AS rank FROM one) WHERE kind <> 0 OR rank <= 8""")
def graph_retrieval(spark, d):
    """Chunks, entities and relationships of each query from one vector pass over all
    three kinds and one step in the graph; every other query is scoped to a nation."""
    e, c, s = table(spark, d, "embeddings"), table(spark, d, "customer"), table(spark, d, "supplier")
    l, p, n = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "nation")
    own = e.select("vec_id", "embedding")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("N"), F.col("item_id") % 25)).alias("scope"))
    asked = asked.join(own.select(F.col("vec_id").alias("query")), "query", "left_semi")
    tell = lambda x, k: F.concat(F.lit(x), k)
    supplier, part, order = tell("S", F.col("l_suppkey")), tell("P", F.col("l_partkey")), F.col("l_orderkey").cast("string")
    g = written(_pairs(l).agg(F.min("l_orderkey").alias("seq")), "edges").select(supplier.alias("src"), part.alias("tgt"), "seq")
    g = g.unionByName(s.select(tell("S", F.col("s_suppkey")).alias("src"), tell("N", F.col("s_nationkey")).alias("tgt"), (-F.col("s_suppkey")).alias("seq")))
    num = lambda k, x, key, kind, at=0: k.select(tell(x, F.col(key)).alias("name"), F.lit(kind == 3).alias("hub"), (F.col(key) * 10 + kind).cast("long").alias("id"), (F.col(key) + at).cast("long").alias("n"))
    gn = num(s, "S", "s_suppkey", 1).unionByName(num(p, "P", "p_partkey", 2)).unionByName(num(n, "N", "n_nationkey", 3, 7))
    of_node = l.select(supplier.alias("name"), order.alias("chunk")).unionByName(l.select(part.alias("name"), order.alias("chunk")))
    of_edge = l.select(supplier.alias("src"), part.alias("tgt"), order.alias("chunk")).select(G.pair_key("src", "tgt").alias("key"), "chunk")
    chunks = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("o_orderkey").alias("chunk"), tell("N", F.col("c_nationkey")).alias("doc"))
    chunks = written(chunks, "chunks")
    number = F.substring("tgt", 2, 100).cast("long")
    corpus = chunks.select(F.lit(0).alias("kind"), F.col("chunk").cast("string").alias("key"), F.col("chunk").alias("id"), F.col("chunk").alias("n"))
    corpus = corpus.unionByName(gn.select(F.lit(1).alias("kind"), F.col("name").alias("key"), "id", "n"))
    corpus = corpus.unionByName(g.select(F.lit(2).alias("kind"), G.pair_key("src", "tgt").alias("key"), (F.col("seq") * 1000000 + number).alias("id"), (F.abs("seq") * 31 + number).alias("n")))
    count = e.agg(F.count(F.lit(1)).alias("_all"))  # one row
    corpus = corpus.crossJoin(F.broadcast(count)).select("kind", "id", "key", (F.col("n") % F.col("_all")).alias("ref"))
    near = vector.top_k_by_reference(asked.join(own.withColumnRenamed("vec_id", "query"), "query").select(F.col("query").alias("id"), "embedding"), own.withColumnRenamed("vec_id", "ref"), corpus, [24, 15, 15])
    hits = near.select(F.col("query_id").alias("query"), "kind", "key", F.round("score", 12).alias("score"))
    out = G.retrieve(asked, hits, gn.select("name", "hub"), g, of_node, of_edge, chunks)
    return out.select("query", "kind", "key", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"), F.md5(F.array_join("sources", ",")).alias("sources"), "rank")
