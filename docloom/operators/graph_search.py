"""Whole graph retrieval for many queries at once: chunks, entities, relationships.

Vector hits of three kinds start it; the graph carries them on; every chunk, entity
and relationship that comes up is a candidate with its channel and score.  One
aggregation merges the candidates by kind and key, and its rows, with their sources,
are all three results.  Sources are looked up only for what comes up.  A scope (a document of a query's own) is judged by the sources of what comes
up: a hit without a source in the scope is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import evidence as E
from docloom.session import written

CHUNK, ENTITY, RELATION = range(3)
#: Channels in the order in which they are listed; a candidate's are bits.
CHANNELS = ["chunk_vector", "entity_source", "entity_vector", "graph_expand", "graph_source", "relationship_source", "relationship_vector"]


def pair_key(a: str, b: str) -> Column:
    """An edge's key, whichever way it is told."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def _in_scope(rows: DataFrame, sources: DataFrame, on: str) -> DataFrame:
    """``rows(query, scope, <on>, ...)`` with each known chunk of theirs in scope."""
    return rows.join(sources, on).where(F.col("scope").isNull() | (F.col("doc") == F.col("scope")))


def _sourced(rows: DataFrame, matched: DataFrame, on: str, anyway: Column) -> DataFrame:
    """Those with a source in scope, or for which ``anyway`` holds."""
    known = matched.select("query", on).distinct().withColumn("_has", F.lit(True))
    return rows.join(known, ["query", on], "left").where(anyway | F.coalesce("_has", F.lit(False))).drop("_has")


def _candidates(rows: DataFrame, kind: int, key: str, channel: str, weight: float) -> DataFrame:
    return rows.select("query", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), (F.col("score") * weight).alias("score"), F.lit(1 << CHANNELS.index(channel)).alias("channels"))


def candidates(queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, node_sources: DataFrame, edge_sources: DataFrame, chunks: DataFrame, depth: int = 1, neighbours: int = E.NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """``(query, kind, key, score, channels)``, all of them, and ``(kind, key, chunk)``,
    the sources of those that have some.

    ``queries(query, scope)``; ``hits(query, kind, key, score)`` with the keys of
    chunks, entities' names and edges' :func:`pair_key`; ``nodes(name, hub)``,
    ``edges(src, tgt, seq)``, ``node_sources(name, chunk)``, ``edge_sources(key, chunk)``,
    ``chunks(chunk, doc)``.  A hub is the node of a document: its name ends with the
    document's, and its sources bring up no chunks.  Sources that are no chunks are
    passed over.  What the queries bring up is written at every step, so the whole
    tables are only scanned for it.
    """
    free = F.col("scope").isNull()
    edges = edges.withColumn("key", pair_key("src", "tgt"))
    c = chunks.select(F.col("chunk").cast("string").alias("chunk"), F.col("doc").cast("string").alias("doc"))
    hits = written(hits.join(queries, "query"), "hits")
    met_sources = []

    def placed(rows: DataFrame, on: str, sources: DataFrame, kind: int) -> DataFrame:
        """``(<on>, chunk, doc)`` of what is in ``rows``."""
        own = written(sources.select(on, F.col("chunk").cast("string").alias("chunk")).join(rows.select(on).distinct(), on, "left_semi"), "sources")
        met_sources.append(own.select(F.lit(kind).alias("kind"), F.col(on).alias("key"), "chunk"))
        return written(own.join(c, "chunk"), "placed")

    direct = hits.where(F.col("kind") == CHUNK).join(c.withColumnRenamed("chunk", "key"), "key").where(free | (F.col("doc") == F.col("scope")))
    out = _candidates(direct, CHUNK, "key", "chunk_vector", 1.0)

    ent = written(hits.where(F.col("kind") == ENTITY).select("query", "scope", F.col("key").alias("name"), "score").join(nodes.select("name", "hub"), "name", "left"), "entities")
    known = F.col("hub").isNotNull()
    at = placed(ent.where(known), "name", node_sources, ENTITY)
    ent = _sourced(ent, _in_scope(ent, at, "name"), "name", free | F.col("name").endswith(F.col("scope")))
    out = out.unionByName(_candidates(ent, ENTITY, "name", "entity_vector", 1.0))
    out = out.unionByName(_candidates(_in_scope(ent.where("not hub"), at, "name"), CHUNK, "chunk", "entity_source", E.ENTITY_WEIGHT))

    rel = written(hits.where(F.col("kind") == RELATION).select("query", "scope", "key", "score").join(edges.select("key", "src", "tgt"), "key"), "relations")
    at = placed(rel, "key", edge_sources, RELATION)
    rel = _sourced(rel, _in_scope(rel, at, "key"), "key", free)
    out = out.unionByName(_candidates(rel, RELATION, "key", "relationship_vector", 1.0))
    out = out.unionByName(_candidates(_in_scope(rel, at, "key"), CHUNK, "chunk", "relationship_source", E.RELATION_WEIGHT))

    ends = [rel.select("query", "scope", F.col(x).alias("name"), "score") for x in ("src", "tgt")]
    seeds = ent.select("query", "scope", "name", "score").unionByName(ends[0]).unionByName(ends[1])
    both = edges.select(F.col("src").alias("name"), F.col("tgt").alias("other"), "key", "seq")
    both = both.unionByName(edges.where("src <> tgt").select(F.col("tgt").alias("name"), F.col("src").alias("other"), "key", "seq"))
    frontier = written(seeds.groupBy("query", "scope", "name").agg(F.max("score").alias("score")), "frontier")
    done = None
    for step in range(depth):
        first = Window.partitionBy("name").orderBy("seq", "other")
        wanted = both.join(frontier.select("name").distinct(), "name", "left_semi")  # edges of other nodes are not ranked
        near = wanted.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= neighbours).drop("_n")
        found = written(frontier.join(near, "name").withColumn("score", F.col("score") * F.pow(F.lit(E.DECAY), F.lit(step + 1))), "found")
        at = placed(found, "key", edge_sources, RELATION)
        found = _sourced(found, _in_scope(found, at, "key"), "key", free)
        out = out.unionByName(_candidates(found, RELATION, "key", "graph_expand", 1.0))
        out = out.unionByName(_candidates(_in_scope(found, at, "key"), CHUNK, "chunk", "graph_source", E.RELATION_WEIGHT))
        met = found.groupBy("query", "scope", F.col("other").alias("name")).agg(F.max("score").alias("score"))
        met = written(met.join(nodes.select("name", "hub"), "name", "left"), "met")
        at = placed(met.where(known), "name", node_sources, ENTITY)
        out = out.unionByName(_candidates(met.where(known), ENTITY, "name", "graph_expand", 1.0))
        out = out.unionByName(_candidates(_in_scope(met.where("not hub"), at, "name"), CHUNK, "chunk", "graph_source", E.ENTITY_WEIGHT))
        if step + 1 < depth:
            done = frontier.select("query", "name") if done is None else done.unionByName(frontier.select("query", "name"))
            frontier = written(met.drop("hub").join(done, ["query", "name"], "left_anti"), "frontier")
    all_sources = met_sources[0]
    for more in met_sources[1:]:
        all_sources = all_sources.unionByName(more)
    return out, all_sources


def merged(rows: DataFrame, sources: DataFrame, final: int) -> DataFrame:
    """``(query, kind, key, score, channels, sources, rank)``: one row per key, the
    best ``final`` chunks and all entities and relationships, ranked in their kind."""
    one = rows.groupBy("query", "kind", "key").agg(F.round(F.max("score"), 9).alias("score"), F.bit_or("channels").alias("_bits"))
    w = Window.partitionBy("query", "kind").orderBy(F.desc("score"), "key")
    ranked = one.withColumn("rank", F.row_number().over(w).cast("long")).where((F.col("kind") != CHUNK) | (F.col("rank") <= final))
    lists = sources.groupBy("kind", "key").agg(F.array_sort(F.collect_set("chunk")).alias("sources"))
    told = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(CHANNELS)]))
    return ranked.join(lists, ["kind", "key"], "left").select("query", "kind", "key", "score", told.alias("channels"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "rank")


def retrieve(queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, node_sources: DataFrame, edge_sources: DataFrame, chunks: DataFrame, final: int = 8, depth: int = 1) -> DataFrame:
    return merged(*candidates(queries, hits, nodes, edges, node_sources, edge_sources, chunks, depth), final)
