"""Registered ingest queries: ids, ordered sets, upserts and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import kg
from docloom.plans.registry import register
from docloom.session import table
from docloom.sources import tables

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)


@query("""SELECT doc_id, 'chunk-' || substr(sha256(doc_id || chr(31) || coalesce(nullif(lang, 'es'), 'None') || chr(31) || text), 1, 24) AS stable, source || '_' || md5(text) AS keyed FROM documents""")
def stable_ids(spark, d):
    own = F.concat("source", F.lit("_"), F.md5("text"))
    return table(spark, d, "documents").select("doc_id", T.stable_id("chunk", F.col("doc_id"), F.nullif("lang", F.lit("es")), F.col("text")).alias("stable"), own.alias("keyed"))


@query("""SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY seq) AS parts FROM (SELECT l_suppkey, l_partkey, min((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS seq FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def ordered_distinct(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))
    x = first.groupBy("l_suppkey").agg(kg.distinct_in_order(F.col("l_partkey").cast("string"), F.col("seq")).alias("p"))
    return x.select("l_suppkey", F.array_join("p", ",").alias("parts"))


@query("""SELECT doc_id, 'new' AS state, quality AS mark FROM labels UNION ALL SELECT doc_id, 'old', -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def upsert_by_key(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("state"), F.lit(-1).alias("mark"))
    return tables.upsert(old, table(spark, d, "labels").select("doc_id", F.lit("new").alias("state"), F.col("quality").alias("mark")), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_antijoin(spark, d):
    return tables.not_done(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def select_chunks_limit(spark, d):
    """The first chunks not yet extracted, as many as one run is given."""
    rest = tables.not_done(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return tables.first_chunks(rest, "doc_id", 25).select("doc_id", "lang")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('fr', 'es') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_items_semi(spark, d):
    """Two languages stand for the content types selected, labels of quality for
    the item ids asked for."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return table(spark, d, "documents").where(F.col("lang").isin("fr", "es")).join(good, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("""SELECT o_orderkey, o_custkey, (SELECT coalesce(max(l_orderkey), -1) FROM lineitem WHERE l_quantity > 45) AS last_done FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def sink_resume_antijoin(spark, d):
    """What a resumed batch still has to write, beside the last id written."""
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    last = done.agg(F.coalesce(F.max("o_orderkey"), F.lit(-1)).alias("last_done"))
    rest = tables.not_done(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")
    return rest.crossJoin(F.broadcast(last))  # one row


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def src_text_scan(spark, d):
    """Scan with pushed-down columns; the text tree reader is tested on files."""
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, coalesce(try_cast(CASE WHEN turn % 4 = 3 THEN 'q' || conv_id ELSE conv_id::VARCHAR END AS INT), -1) AS id FROM conversations
WHERE coalesce(try_cast(CASE WHEN turn % 4 = 3 THEN 'q' || conv_id ELSE conv_id::VARCHAR END AS INT), -1) BETWEEN 10 AND 2000000""")
def src_id_range_filter(spark, d):
    ident = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("q"), "conv_id")).otherwise(F.col("conv_id").cast("string"))
    c = table(spark, d, "conversations").withColumn("qid", ident)
    return tables.id_range(c, "qid", 10, 2000000).select("conv_id", "turn", F.coalesce(F.col("qid").try_cast("int"), F.lit(-1)).alias("id"))
