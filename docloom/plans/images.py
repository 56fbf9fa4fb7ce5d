"""Registered queries on images, records, stores and traces, each with the SQL it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import images as I
from docloom.operators import layout as L
from docloom.plans.layout import BOX, boxes
from docloom.plans.registry import register
from docloom.session import table
from docloom.sources import stores

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)


@query("SELECT doc_id, 'data:image/' || lang || ';base64,' || base64(encode(text)) AS url FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def data_urls(spark, d):
    docs = table(spark, d, "documents").where("text is not null and lang is not null")
    return docs.select("doc_id", I.data_url(F.concat(F.lit("image/"), "lang"), F.encode("text", "utf-8")).alias("url"))


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data:image/JPEG;base64,' WHEN 1 THEN '' ELSE 'data:text/plain;base64,' END AS head, base64(encode(text)) AS body, text FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' END AS mime, CASE WHEN doc_id % 3 < 2 THEN octet_length(encode(text))::INT END AS size_bytes, CASE WHEN doc_id % 3 < 2 THEN md5(text) END AS digest FROM v""")
def image_inputs(spark, d):
    """Data URLs and plain base64; a third of the inputs is neither."""
    k = F.col("doc_id") % 3
    head = F.when(k == 0, "data:image/JPEG;base64,").when(k == 1, "").otherwise("data:text/plain;base64,")
    x = table(spark, d, "documents").select("doc_id", I.decoded(F.concat(head, I.base64(F.encode("text", "utf-8")))).alias("x"))
    return x.select("doc_id", "x.mime", "x.size_bytes", F.md5("x.content").alias("digest"))


@query("""WITH f AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['/b/' || doc_id || '.png', '/a/' || doc_id || '.gif'] WHEN 1 THEN ['/a/' || doc_id || '.jpg', '/a/' || doc_id || '.png'] WHEN 2 THEN ['/a/' || doc_id || '.bmp', '/c/' || doc_id || '.png'] ELSE ['/b/' || doc_id || '.webp'] END) AS path FROM documents)
SELECT 'manuals/' || doc_id AS image_id, arg_min(path, CASE WHEN path LIKE '/a/%' THEN 0 ELSE 10 END + list_position(['.png', '.jpg', '.jpeg', '.webp', '.gif'], regexp_extract(path, '\\.[a-z]+$'))) AS path
FROM f WHERE (path LIKE '/a/%' OR path LIKE '/b/%') AND NOT path LIKE '%.bmp' GROUP BY doc_id""")
def image_assets(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    at = lambda folder, end: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(end))
    k = F.col("doc_id") % 4
    paths = F.when(k == 0, F.array(at("/b/", ".png"), at("/a/", ".gif"))).when(k == 1, F.array(at("/a/", ".jpg"), at("/a/", ".png"))).when(k == 2, F.array(at("/a/", ".bmp"), at("/c/", ".png"))).otherwise(F.array(at("/b/", ".webp")))
    return I.find_assets(docs.select(at("manuals/", "").alias("image_id")), docs.select(F.explode(paths).alias("path")), ["/a", "/b"])


SEEN = "SELECT conv_id, turn // 2 + 1 AS pos, CASE turn % 6 WHEN 1 THEN 0 WHEN 3 THEN turn // 2 + 2 END AS idx, text FROM conversations WHERE role = 'assistant'"


@query(f"""WITH s AS ({SEEN}), o AS (SELECT conv_id, coalesce(nullif(idx, 0), pos) AS idx, arg_max(text, pos) AS text FROM s GROUP BY ALL)
SELECT c.conv_id, turn // 2 + 1 AS index, md5(trim(coalesce(o.text, ''))) AS summary FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') c LEFT JOIN o ON o.conv_id = c.conv_id AND o.idx = c.turn // 2 + 1""")
def image_observations(spark, d):
    """User turns stand for images, the assistant's for what a model saw."""
    c = table(spark, d, "conversations").withColumn("pos", (F.floor(F.col("turn") / 2) + 1).cast("long"))
    shown = c.where("role = 'user'").select("conv_id", F.col("pos").alias("index"), "turn").distinct().drop("turn")
    k = F.col("turn") % 6
    seen = c.where("role = 'assistant'").select("conv_id", "pos", F.when(k == 1, 0).when(k == 3, F.col("pos") + 1).alias("index"), F.col("text").alias("summary"))
    return I.with_observations(shown, seen, "conv_id").select("conv_id", "index", F.md5("summary").alias("summary"))


@query("""WITH o AS (SELECT conv_id, string_agg('[image_' || turn || '] ' || trim(text, ' '), chr(10) ORDER BY turn, text) AS ocr FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id),
q AS (SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(ocr) AS ocr_text, md5(role || CASE WHEN conv_id % 2 = 0 THEN '' ELSE chr(10) || 'E' || conv_id END || chr(10) || 'OCR: ' || ocr) AS suggested, md5('ocr: ' || trim(ocr, ' ') || chr(10) || 'product_type: ' || role || CASE WHEN conv_id % 2 = 0 THEN '' ELSE chr(10) || 'visible_error_code: E' || conv_id END || chr(10) || 'visible_parts: lid, ' || role) AS context FROM q JOIN o USING (conv_id)""")
def observation_texts(spark, d):
    c = table(spark, d, "conversations")
    ocr = I.ocr_lines(c.select("conv_id", F.col("turn").alias("index"), F.col("text").alias("ocr_text")), "conv_id")
    x = c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).join(ocr, "conv_id")
    code = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("E"), F.col("conv_id")))
    wanted = I.suggested_query(F.col("role"), F.lit(" "), code, F.col("role"), ocr_text=F.col("ocr_text"))
    context = I.compact_context({"ocr_text": F.col("ocr_text"), "visible_error_code": code, "product_type": F.col("role"), "brand_or_model": F.lit(" ")}, F.array(F.lit("lid"), F.col("role")))
    return x.select("conv_id", F.md5("ocr_text").alias("ocr_text"), F.md5(wanted).alias("suggested"), F.md5(context).alias("context"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '怎么安装' ELSE source END AS q, CASE WHEN doc_id % 3 > 0 THEN lang ELSE ' ' END AS p, CASE WHEN doc_id % 5 > 1 THEN 'E' || doc_id ELSE '' END AS c FROM documents),
y AS (SELECT *, CASE WHEN trim(coalesce(p, '')) = '' THEN c WHEN c = '' THEN p ELSE p || CASE WHEN doc_id % 2 = 0 THEN '、' ELSE ', ' END || c END AS clue FROM x)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Which one?' WHEN doc_id % 2 = 0 AND clue <> '' THEN '我看到图片中有 ' || clue || ' 这些线索，但还需要您补充产品名称、型号或想处理的具体目标，我再帮您继续判断。' WHEN doc_id % 2 = 0 THEN '我看到您上传了图片，但还需要您补充具体想咨询的问题、产品类型或使用场景，我再帮您继续处理。'
WHEN clue <> '' THEN 'I can see ' || clue || ' in the image, but I still need the product model or your exact goal before proceeding.' ELSE 'I can see the uploaded image, but I need your exact question or product context before proceeding.' END AS answer FROM y""")
def image_followup(spark, d):
    i = F.col("doc_id")
    q = F.when(i % 2 == 0, "怎么安装").otherwise(F.coalesce("source", F.lit("")))
    said = F.when(i % 7 == 0, " Which one? ")
    return table(spark, d, "documents").select("doc_id", I.followup(q, F.when(i % 3 > 0, F.col("lang")).otherwise(" "), F.when(i % 5 > 1, F.concat(F.lit("E"), i)), said).alias("answer"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE p_brand || ', ' || p_type END AS shown, CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE p_brand || ' > ' || p_type END AS section,
CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'bin' WHEN 2 THEN 'bin' WHEN 3 THEN 'bin' ELSE '7z' END AS ext FROM part""")
def list_texts(spark, d):
    k = F.col("p_partkey")
    parts = F.when(k % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(""), F.col("p_brand"), F.col("p_type")))
    ext = F.when(k % 5 == 0, "..PNG").when(k % 5 == 1, "tar.gz").when(k % 5 == 2, "").when(k % 5 == 4, "7z")
    return table(spark, d, "part").select("p_partkey", T.format_list(parts).alias("shown"), T.section_text(parts).alias("section"), T.safe_extension(ext).alias("ext"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '...' ELSE t END AS preview FROM t""")
def trace_brief(spark, d):
    return table(spark, d, "documents").select("doc_id", stores.brief(F.col("text")).alias("preview"))


@query("""SELECT doc_id, 1 AS version_of, quality AS mark FROM labels UNION ALL SELECT doc_id, 0, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def store_last_version(spark, d):
    """A second save replaces a document's rows; the others keep their first."""
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("mark"), F.lit(0).alias("version"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").alias("mark"), F.lit(1).alias("version"))
    rows = old.unionByName(new).withColumn("version_of", F.col("version"))
    return stores.last_version(rows, "doc_id")


@query("""SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)""")
def store_mismatch(spark, d):
    """Rows that name a document which the store does not hold."""
    return stores.mismatched(table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), table(spark, d, "labels"), "doc_id").withColumnRenamed("doc_id", "item_id")


@query("""SELECT p_partkey, p_name AS name, lower(p_type) AS type, p_brand AS description FROM part WHERE p_partkey % 4 > 0""")
def entity_records(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), F.concat("p_type", F.lit("\t")).alias("type"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).otherwise(" ").alias("description"))
    return stores.entity_records(x)[0]


@query("""SELECT p_partkey, p_name AS source, p_type AS target, p_brand AS description, p_brand || '|' || p_type AS keywords, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE ELSE p_size::DOUBLE END AS weight FROM part WHERE p_partkey % 3 < 2""")
def relationship_records(spark, d):
    k = F.col("p_partkey") % 3
    x = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.col("p_brand").alias("description"), F.concat(F.lit(" ,"), "p_brand", F.lit(" ,, "), "p_type").alias("keywords"), F.when(k == 0, 0.0).when(k == 1, F.col("p_size").cast("double")).otherwise(-1.0).alias("weight"))
    return stores.relationship_records(x)[0].withColumn("keywords", F.array_join("keywords", "|"))


@query(f"""WITH {BOX}, t AS (SELECT *, CASE id % 5 WHEN 0 THEN 'E = mc^2' WHEN 1 THEN 'E = mc^2 (12)' WHEN 2 THEN 'the value of some x = 3 for all' WHEN 3 THEN 'f(x)' ELSE 'a + b' END AS t, x0 < 300 AND x1 > 300 AS crosses, (x0 + x1) / 2 AS c FROM box)
SELECT id, id % 5 IN (0, 3, 4) AND abs(c - CASE WHEN crosses THEN 300 WHEN c < 300 THEN 150 ELSE 450 END) <= CASE WHEN crosses THEN 120 ELSE 90 END AND x1 - x0 <= 480 AS display,
CASE id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE id % 10 >= 2 END AS complete FROM t""")
def display_equation(spark, d):
    k = F.col("id") % 5
    t = F.when(k == 0, "E = mc^2").when(k == 1, "E = mc^2 (12)").when(k == 2, "the value of some x = 3 for all").when(k == 3, "f(x)").otherwise("a + b")
    own = L.display_equation(t, F.lit(0.0), F.col("x0"), F.col("x1"), 0.0, 600.0)
    return boxes(spark, d).select("id", own.alias("display"), L.complete_equation(t, F.col("id") % 10, F.lit(10)).alias("complete"))
