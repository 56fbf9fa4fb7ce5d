"""Registered knowledge-graph queries over customers, nations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import kg, order
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

ENT = """
ent AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) ELSE '  ' || lower(n_name) || ' ' END AS name, lower(c_mktsegment) AS type,
  'serves ' || (c_custkey % 11) || ' in ' || c_mktsegment AS description, c_custkey AS seq FROM customer JOIN nation ON n_nationkey = c_nationkey)
"""


def _entities(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
    text = F.concat(F.lit("serves "), F.col("c_custkey") % 11, F.lit(" in "), F.col("c_mktsegment"))
    return c.select(name.alias("name"), F.lower("c_mktsegment").alias("type"), text.alias("description"), F.col("c_custkey").alias("seq"))


KEY = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query(f"""WITH {ENT}, k AS (SELECT *, {KEY.format('name')} AS key FROM ent), f AS (SELECT key, description, min(seq) AS seq FROM k GROUP BY ALL),
t AS (SELECT key, string_agg(description, ' ' ORDER BY seq) AS t FROM f GROUP BY key)
SELECT key, arg_min(name, seq) AS name, arg_min(type, seq) AS type, count(*) AS mentions, any_value(CASE WHEN length(t) <= 2000 THEN t ELSE rtrim(substr(t, 1, 1997)) || '...' END) AS description FROM k JOIN t USING (key) GROUP BY key""")
def kg_merge_entities(spark, d):
    return kg.merge_entities(_entities(spark, d))


REL = """
rel AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN s_name ELSE upper(n_name) END AS src, CASE WHEN l_linenumber % 2 = 0 THEN n_name ELSE s_name END AS tgt,
  'moves ' || (l_orderkey % 5) AS description, CASE WHEN l_tax > 0.04 THEN 'k' || (l_orderkey % 3) ELSE '' END AS keyword, l_quantity / 4 AS weight, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_orderkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
"""


def _relations(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    even = F.col("l_linenumber") % 2 == 0
    return l.select(
        F.when(even, F.col("s_name")).otherwise(F.upper("n_name")).alias("src"), F.when(even, F.col("n_name")).otherwise(F.col("s_name")).alias("tgt"),
        F.concat(F.lit("moves "), F.col("l_orderkey") % 5).alias("description"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("k"), F.col("l_orderkey") % 3)).otherwise("").alias("keyword"),
        (F.col("l_quantity") / 4).alias("weight"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), "l_orderkey",
    )


PAIR = f"least({KEY.format('src')}, {KEY.format('tgt')}) AS a, greatest({KEY.format('src')}, {KEY.format('tgt')}) AS b"


@query(f"""WITH {REL}, p AS (SELECT *, {PAIR} FROM rel),
dd AS (SELECT a, b, string_agg(description, ' ' ORDER BY seq) AS description FROM (SELECT a, b, description, min(seq) AS seq FROM p GROUP BY ALL) GROUP BY a, b),
kk AS (SELECT a, b, string_agg(keyword, ',' ORDER BY seq) AS keywords FROM (SELECT a, b, keyword, min(seq) AS seq FROM p WHERE keyword <> '' GROUP BY ALL) GROUP BY a, b)
SELECT a, b, arg_min(src, seq) AS src, arg_min(tgt, seq) AS tgt, max(weight) AS weight, any_value(dd.description) AS description, coalesce(any_value(keywords), 'related_to') AS keywords
FROM p JOIN dd USING (a, b) LEFT JOIN kk USING (a, b) GROUP BY a, b""")
def kg_merge_relationships(spark, d):
    return kg.merge_relationships(_relations(spark, d))


@query(f"""WITH {REL}, p AS (SELECT l_orderkey AS chunk, {PAIR}, keyword, seq, least(greatest(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END, 1), 10) AS weight FROM rel WHERE {KEY.format('src')} <> {KEY.format('tgt')}),
kk AS (SELECT chunk, a, b, string_agg(keyword, ',' ORDER BY seq) AS keywords FROM (SELECT chunk, a, b, keyword, min(seq) AS seq FROM p WHERE keyword <> '' GROUP BY ALL) GROUP BY chunk, a, b)
SELECT chunk, a, b, max(weight) AS weight, coalesce(any_value(keywords), 'related_to') AS keywords FROM p LEFT JOIN kk USING (chunk, a, b) GROUP BY chunk, a, b""")
def kg_in_chunk_rels(spark, d):
    return kg.in_chunk_relationships(_relations(spark, d).withColumnRenamed("l_orderkey", "chunk"), "chunk")


@query("""WITH RECURSIVE r AS (SELECT c_custkey // 10 AS k, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) AS n, c_mktsegment AS t FROM customer),
f AS (SELECT k, n, t AS text FROM r WHERE n = 1 UNION ALL SELECT f.k, r.n, CASE WHEN contains(f.text, r.t) THEN f.text ELSE f.text || ' ' || r.t END FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1)
SELECT k, arg_max(text, n) AS text FROM f GROUP BY k""")
def fold_append_if_absent(spark, d):
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10).alias("k"), F.col("c_mktsegment").alias("text"), F.col("c_custkey").alias("seq"))
    return kg.append_if_absent(c, "k")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY lpad(doc_id::VARCHAR, 12, '0')) = 1 THEN source || ' (' || lang || ')'
ELSE source || ' (' || lang || ') [' || right(lpad(doc_id::VARCHAR, 12, '0'), 8) || ']' END AS unique_name FROM documents""")
def unique_entity_name(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("ident"), F.lit(1).alias("k"))
    return kg.unique_names(x, "k", "source", "lang", "ident").select("doc_id", "unique_name")


PAYLOAD = """
chunks AS (SELECT doc_id, 'chunk-' || doc_id AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_order, source AS document FROM documents),
docs AS (SELECT document, arg_min(source_id, doc_id) AS first_chunk FROM chunks GROUP BY document)
"""


@query(f"""WITH {PAYLOAD} SELECT 'chunk' AS kind, source_id AS name, document AS other, chunk_order::BIGINT AS n FROM chunks
UNION ALL SELECT 'entity', lang || ' (lang)', arg_min('chunk-' || doc_id, doc_id), count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'entity', 'DOCUMENT::' || document, first_chunk, 1 FROM docs
UNION ALL SELECT DISTINCT 'belongs_to', lang || ' (lang)', 'DOCUMENT::' || source, 10 FROM documents""")
def kg_build_payload(spark, d):
    """Chunks in order, entities, one document hub per document, its edges."""
    docs = table(spark, d, "documents").withColumn("source_id", F.concat(F.lit("chunk-"), "doc_id"))
    own = order.numbered(docs.select("source_id", "source", "doc_id"), "source", "doc_id", "n")
    chunk = own.select(F.lit("chunk").alias("kind"), F.col("source_id").alias("name"), F.col("source").alias("other"), "n")
    name = F.concat("lang", F.lit(" (lang)"))
    ents = docs.groupBy(name.alias("name")).agg(F.min_by("source_id", "doc_id").alias("other"), F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "name", "other", "n")
    hub = F.concat(F.lit("DOCUMENT::"), "source")
    hubs = docs.groupBy(hub.alias("name")).agg(F.min_by("source_id", "doc_id").alias("other")).select(F.lit("entity").alias("kind"), "name", "other", F.lit(1).cast("long").alias("n"))
    edge = docs.select(F.lit("belongs_to").alias("kind"), name.alias("name"), hub.alias("other"), F.lit(10).cast("long").alias("n")).distinct()
    return chunk.unionByName(ents).unionByName(hubs).unionByName(edge)


@query(f"""WITH x AS (SELECT source, len(list_distinct(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+'))) AS entities, len(regexp_extract_all(text, '[.]')) AS relationships FROM documents)
SELECT source, count(*) AS chunks, sum(entities)::BIGINT AS entities, sum(relationships)::BIGINT AS relationships FROM x GROUP BY source""")
def index_report(spark, d):
    e = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-zà-ÿ]+)"), 1)))
    r = F.regexp_count("text", F.lit("[.]"))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(e).alias("entities"), F.sum(r).alias("relationships"))


@query("""SELECT doc_id::VARCHAR AS key, 'unknown document' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')
UNION ALL SELECT source, 'duplicate id' FROM documents GROUP BY source HAVING count(*) > 1
UNION ALL SELECT doc_id::VARCHAR, 'blank text' FROM documents WHERE trim(text) = ''
UNION ALL SELECT doc_id::VARCHAR, 'bad count' FROM documents WHERE n_chars <> length(text)""")
def validate_refs(spark, d):
    """What a strict build would refuse, as a quarantine table."""
    docs = table(spark, d, "documents")
    bad = kg.dangling(table(spark, d, "labels"), "doc_id", docs.where("lang <> 'de'"), "doc_id", "unknown document").unionByName(kg.duplicates(docs, "source", "duplicate id"))
    ident = F.col("doc_id").cast("string").alias("key")
    blank = docs.where(F.trim("text") == "").select(ident, F.lit("blank text").alias("problem"))
    return bad.unionByName(blank).unionByName(docs.where(F.col("n_chars") != F.length("text")).select(ident, F.lit("bad count").alias("problem")))


@query(f"SELECT doc_id, md5({KEY.format('text')}) AS key FROM documents")
def casefold_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.casefold_key(F.col("text"))).alias("key"))
