"""Registered text, section and context queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

LINES = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS order_idx FROM documents),
items AS (SELECT doc_id, order_idx, (order_idx // 4) AS page_idx, trim(regexp_replace(r, '\\s+', ' ', 'g')) AS text FROM raw WHERE trim(regexp_replace(r, '\\s+', ' ', 'g')) <> '')
"""


def items(spark, d):
    return C.lines(table(spark, d, "documents"))


@query(f"""WITH {LINES}, rep AS (SELECT doc_id, text FROM items WHERE length(text) <= 160 GROUP BY ALL HAVING count(DISTINCT page_idx) >= 3)
SELECT doc_id, order_idx, page_idx, md5(text) AS digest FROM items WHERE (doc_id, text) NOT IN (SELECT doc_id, text FROM rep)""")
def boilerplate_antijoin(spark, d):
    return C.boilerplate(items(spark, d), "doc_id", "page_idx", "text").select("doc_id", "order_idx", "page_idx", F.md5("text").alias("digest"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, order_idx, text FROM items UNION ALL SELECT doc_id, order_idx, (CASE WHEN order_idx % 2 = 0 THEN 'Page ' ELSE '' END) || (order_idx + 1) FROM items WHERE order_idx % 9 = 0)
SELECT doc_id, order_idx, md5(text) AS digest FROM m WHERE NOT regexp_full_match(text, '(?i)(page\\s+)?\\d{{1,4}}')""")
def filter_page_number(spark, d):
    """A page number is put before every ninth line, then page numbers go."""
    mark = F.concat(F.when(F.col("order_idx") % 2 == 0, "Page ").otherwise(""), (F.col("order_idx") + 1).cast("string"))
    x = items(spark, d)
    x = x.unionByName(x.where("order_idx % 9 = 0").withColumn("text", mark))
    return x.where(~T.is_page_number(F.col("text"))).select("doc_id", "order_idx", F.md5("text").alias("digest"))


MARKED = LINES + """, marked AS (SELECT doc_id, order_idx, page_idx, CASE order_idx % 11 WHEN 3 THEN (order_idx // 11 + 1) || ' ' || text WHEN 5 THEN (order_idx // 11 + 1) || '.2 ' || text WHEN 7 THEN upper(replace(text, 'ß', 's')) WHEN 8 THEN 'Abstract' ELSE text END AS text FROM items)"""
LV = r"""regexp_replace({t}, '[^\p{{L}}]', '', 'g')"""
LEVEL = r"""CASE WHEN length(text) > 160 OR len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) > 16 THEN NULL
WHEN regexp_matches(text, '^\d+(\.\d+)*[.)]?\s+\S') THEN len(string_split(regexp_extract(text, '^(\d+(?:\.\d+)*)', 1), '.'))
WHEN regexp_matches(text, '^[A-Z](\.\d+)*[.)]?\s+\S') THEN CASE WHEN {title} <> '' AND upper({title}) = {title} AND NOT contains(regexp_extract(text, '^[A-Z](?:\.\d+)*[.)]?\s+(\S.*)$', 1), '=') THEN len(string_split(regexp_extract(text, '^([A-Z](?:\.\d+)*)', 1), '.')) END
WHEN upper(text) IN ('ABSTRACT', 'ACKNOWLEDGMENTS', 'APPENDIX', 'CONCLUSION', 'REFERENCES') THEN 1
WHEN len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) >= 2 AND length({all}) >= 4 AND upper({all}) = {all} AND NOT contains(text, '=') THEN 1 END""".replace("{title}", r"regexp_replace(regexp_extract(text, '^[A-Z](?:\.\d+)*[.)]?\s+(\S.*)$', 1), '[^\p{L}]', '', 'g')").replace("{all}", r"regexp_replace(text, '[^\p{L}]', '', 'g')")


def marked(spark, d):
    n = (F.floor(F.col("order_idx") / 11) + 1).cast("string")
    kind = F.col("order_idx") % 11
    text = F.when(kind == 3, F.concat(n, F.lit(" "), "text")).when(kind == 5, F.concat(n, F.lit(".2 "), "text")).when(kind == 7, F.upper(F.replace("text", F.lit("ß"), F.lit("s")))).when(kind == 8, "Abstract").otherwise(F.col("text"))
    return items(spark, d).withColumn("text", text)


@query(f"WITH {MARKED} SELECT doc_id, order_idx, ({LEVEL})::INT AS level FROM marked")
def heading_level(spark, d):
    """Every eleventh line is made a numbered, capital or standalone heading."""
    return marked(spark, d).select("doc_id", "order_idx", T.heading_level(F.col("text")).cast("int").alias("level"))


@query(f"""WITH RECURSIVE {MARKED}, l AS (SELECT doc_id, order_idx, text, ({LEVEL})::INT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx) AS n FROM marked),
f AS (SELECT doc_id, n, CASE WHEN level IS NULL THEN []::VARCHAR[] ELSE [text] END AS p FROM l WHERE n = 1
UNION ALL SELECT f.doc_id, l.n, CASE WHEN level IS NULL THEN p ELSE list_concat(p[1:greatest(level - 1, 0)], [text]) END FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT l.doc_id, order_idx, level, md5(array_to_string(p, ' > ')) AS path FROM f JOIN l USING (doc_id, n)""")
def section_path(spark, d):
    x = marked(spark, d).withColumn("level", T.heading_level(F.col("text")).cast("int"))
    return C.section_path(x, "doc_id", "order_idx", "text", "level").select("doc_id", "order_idx", "level", F.md5(F.array_join("section_path", " > ")).alias("path"))


@query(f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, order_idx, text, CASE WHEN order_idx % 7 = 2 THEN 1 + order_idx % 3 END AS level, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx) AS n FROM items),
f AS (SELECT doc_id, n, CASE WHEN level IS NULL THEN [] ELSE [{{'l': level, 't': text}}] END AS p FROM l WHERE n = 1
UNION ALL SELECT f.doc_id, l.n, CASE WHEN level IS NULL THEN p ELSE list_append(list_filter(p, lambda x: x.l < level), {{'l': level, 't': text}}) END FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
s AS (SELECT doc_id, order_idx, text, array_to_string(list_transform(p, lambda x: x.t), ' > ') AS path, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY order_idx) AS section FROM f JOIN l USING (doc_id, n))
SELECT doc_id, section::BIGINT AS section, md5(CASE WHEN section = 0 THEN '未命名章节' ELSE any_value(path) END) AS path, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY order_idx)) AS body FROM s GROUP BY doc_id, section""")
def md_sections(spark, d):
    """Every seventh line is made a heading of level 1 to 3."""
    from pyspark.sql import Window

    x = items(spark, d).withColumn("level", F.when(F.col("order_idx") % 7 == 2, 1 + F.col("order_idx") % 3))
    x = C.stacked_path(x, "doc_id", "order_idx", "text", "level")
    x = x.withColumn("section", F.sum(F.when(F.col("level").isNull(), 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("order_idx")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda r: r["text"]), "\n")
    path = F.when(F.col("section") == 0, "未命名章节").otherwise(F.first("section_path"))
    return x.groupBy("doc_id", "section").agg(F.md5(path).alias("path"), F.count(F.lit(1)).alias("lines"), F.md5(body).alias("body"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS t, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS n FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS digest FROM s WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''""")
def sentence_split(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "t"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("t").alias("digest"))


@query("""WITH n AS (SELECT doc_id, text, greatest(0, ceil((length(text) - 800) / 700.0))::INT AS last FROM documents), w AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM n)
SELECT doc_id, i::INT AS sub_index, md5(substr(text, i * 700 + 1, 800)) AS digest, length(substr(text, i * 700 + 1, 800)) AS n FROM w""")
def chunk_fixed_window(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(C.fixed_windows(F.col("text"), 800, 100)).alias("w"))
    return x.select("doc_id", "w.sub_index", F.md5("w.text").alias("digest"), F.length("w.text").cast("long").alias("n"))


APPROX = r"(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: ceil(length(w) / 4.0)::BIGINT)) + length(regexp_replace(text, '[\sA-Za-z0-9_]', '', 'g')))"


@query(f"SELECT doc_id, coalesce({APPROX}, length(regexp_replace(text, '[\\sA-Za-z0-9_]', '', 'g')))::BIGINT AS tokens FROM documents")
def approx_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.approx_token_count(F.col("text")).alias("tokens"))


@query(f"WITH t AS (SELECT source, {APPROX}::BIGINT AS n FROM documents) SELECT source, coalesce(min(n), 0) AS least, coalesce(max(n), 0) AS most, coalesce(round(avg(n), 2), 0) AS mean FROM t GROUP BY source")
def token_stats(spark, d):
    n = table(spark, d, "documents").select("source", T.approx_token_count(F.col("text")).alias("n")).groupBy("source")
    zero = F.lit(0).cast("long")
    return n.agg(F.coalesce(F.min("n"), zero).alias("least"), F.coalesce(F.max("n"), zero).alias("most"), F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("mean"))


@query("SELECT t.type, count(d.doc_id) AS n FROM (VALUES ('text'), ('image'), ('table'), ('equation')) t(type) LEFT JOIN (SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[=∑√]') THEN 'equation' ELSE 'text' END AS type FROM documents) d ON d.type = t.type GROUP BY t.type")
def count_by_type(spark, d):
    """All four types appear, also without rows."""
    kind = F.when(F.contains("text", F.lit(" | ")), "table").when(F.col("text").rlike("[=∑√]"), "equation").otherwise("text")
    n = table(spark, d, "documents").groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    types = spark.createDataFrame([(t,) for t in ("text", "image", "table", "equation")], "type string")
    return types.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def chunk_greedy(spark, d):
    x = items(spark, d).withColumn("section", F.concat(F.lit("part "), F.floor(F.col("order_idx") / 12)))
    return C.greedy_chunks(x.select(F.col("doc_id").alias("document_id"), "section", F.col("order_idx").cast("long").alias("order_idx"), "page_idx", "text"), C.Config())


@query(f"""WITH {LINES}, k AS (SELECT *, length(text) % 5 AS n FROM items)
SELECT doc_id, order_idx, md5(CASE WHEN n = 0 THEN '[Image: ' || text || ', ' || page_idx || ']' WHEN n = 1 THEN '[Table: ' || text || ']' WHEN n = 2 THEN '' WHEN n = 3 THEN text WHEN length(text) % 4 > 0 THEN repeat('#', length(text) % 4) || ' ' || text ELSE text END) AS shown FROM k""")
def item_texts(spark, d):
    """Items as context, by kind and level: images and tables by captions (or none),
    equations, headings and plain text."""
    n, size = F.length("text") % 5, F.length("text") % 4
    kind = F.when(n == 0, "image").when(n == 1, "table").when(n == 2, "image").when(n == 3, "equation").otherwise("text")
    captions = F.when(n == 0, F.array("text", F.col("page_idx").cast("string"))).when(n == 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    return items(spark, d).select("doc_id", "order_idx", F.md5(T.item_text(kind, F.col("text"), size, captions)).alias("shown"))


@query(f"""WITH {LINES} SELECT a.doc_id, a.order_idx, md5(coalesce(string_agg(CASE WHEN b.page_idx = a.page_idx THEN b.text ELSE '[Page ' || (b.page_idx + 1) || '] ' || b.text END, chr(10) ORDER BY b.order_idx), '')) AS context
FROM items a LEFT JOIN items b ON b.doc_id = a.doc_id AND b.page_idx BETWEEN a.page_idx - 1 AND a.page_idx + 1 AND b.order_idx <> a.order_idx GROUP BY a.doc_id, a.order_idx""")
def context_page_window(spark, d):
    return C.pages_around(items(spark, d), "doc_id", "page_idx", "order_idx", "text", 1).select("doc_id", "order_idx", F.md5("context").alias("context"))


@query(f"""WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_idx) AS n FROM items)
SELECT a.doc_id, a.order_idx, md5(coalesce(string_agg(b.text, chr(10) ORDER BY b.n), '')) AS context FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.n <> a.n GROUP BY a.doc_id, a.order_idx""")
def context_chunk_window(spark, d):
    return C.around(items(spark, d), "doc_id", "order_idx", "text", 2, 2).select("doc_id", "order_idx", F.md5("context").alias("context"))


@query(r"""WITH c AS (SELECT doc_id, text, substr(text, 1, 400) AS cut FROM documents), p AS (SELECT *, CASE WHEN contains(cut, '.') THEN length(cut) - strpos(reverse(cut), '.') + 1 ELSE 0 END AS dot, CASE WHEN contains(cut, chr(10)) THEN length(cut) - strpos(reverse(cut), chr(10)) ELSE -1 END AS nl FROM c)
SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN dot - 1 > 0.8 * length(cut) THEN substr(cut, 1, dot) WHEN nl > 0.8 * length(cut) THEN substr(cut, 1, nl) ELSE regexp_replace(cut, '\s+$', '') || '...' END) AS cut FROM p""")
def truncate_context(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate_context(F.col("text"), 400)).alias("cut"))


WS = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({WS}) <= 120 THEN {WS} ELSE substr({WS}, 1, 120) || '...' END AS preview FROM documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 120).alias("preview"))


@query("SELECT doc_id // 6 AS question, md5(string_agg('---' || chr(10) || 'manual_id: ' || source || chr(10) || 'section_path: ' || lang || ' > ' || doc_id || chr(10) || 'image_ids: ' || CASE WHEN doc_id % 3 = 0 THEN 'img' || doc_id ELSE '无' END || chr(10) || 'text:' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS context, count(*) AS n FROM documents GROUP BY doc_id // 6")
def build_context(spark, d):
    """Six whole documents in a row are the evidence of one question."""
    nl = F.lit("\n")
    images = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("img"), "doc_id")).otherwise("无")
    block = F.concat(F.lit("---"), nl, F.lit("manual_id: "), "source", nl, F.lit("section_path: "), "lang", F.lit(" > "), "doc_id", nl, F.lit("image_ids: "), images, nl, F.lit("text:"), nl, "text")
    x = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 6).alias("question"), "doc_id", block.alias("b"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "b"))), lambda r: r["b"]), "\n\n")
    return x.groupBy("question").agg(F.md5(whole).alias("context"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(trim(replace(text, 'tion', 'ti- ' || chr(10) || ' on')), '([a-zA-Z0-9_à-ÿ])-\s*\n\s*([a-zA-Z0-9_à-ÿ])', '\1\2', 'g'), '\s*\n+\s*', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS norm FROM documents""")
def text_normalize(spark, d):
    x = F.replace("text", F.lit("tion"), F.lit("ti- \n on"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_paragraph(x)).alias("norm"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(9)), chr(13), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS norm FROM documents""")
def text_normalize_c(spark, d):
    x = F.replace("text", F.lit(". "), F.lit(".\r\n\r\n\n\t"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_lines(x)).alias("norm"))


@query(f"SELECT doc_id, md5({WS}) AS norm FROM documents")
def ws_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.ws_normalize(F.col("text"))).alias("norm"))


MIXED = "CASE doc_id % 4 WHEN 0 THEN '产品 ' || text WHEN 1 THEN regexp_replace(text, '[A-Za-z]', '', 'g') ELSE text END"


def _mixed():
    return F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("产品 "), "text")).when(F.col("doc_id") % 4 == 1, F.regexp_replace("text", "[A-Za-z]", "")).otherwise(F.col("text"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches({MIXED}, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' WHEN regexp_matches({MIXED}, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language(_mixed()).alias("language"))


@query(f"SELECT doc_id, length(regexp_replace({MIXED}, '[^A-Za-z]', '', 'g')) >= 10 AND length(regexp_replace({MIXED}, '[^A-Za-z]', '', 'g')) > 3 * length(regexp_replace({MIXED}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS english FROM documents")
def looks_english(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_english(_mixed()).alias("english"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace('😀 ' || replace(text, ' de ', ' **de** ') || ' [证据 3] (Passage 12) ☀️', '[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]\x{fe0f}?', '', 'g'), '\*\*(.*?)\*\*', '\1', 'g'),
'(?i)[<（(【\[]\s*(?:证据|資料|资料|片段|passage|evidence)\s*\d+\s*[>）)】\]]', '', 'g'), '^\s+|\s+$', '', 'g')) AS answer FROM documents""")
def clean_answer(spark, d):
    x = F.concat(F.lit("😀 "), F.replace("text", F.lit(" de "), F.lit(" **de** ")), F.lit(" [证据 3] (Passage 12) ☀️"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_answer(x)).alias("answer"))


def _sanitize_sql():
    x = "'OCR shows ' || replace(text, ' the ', ' detected by OCR ') || ' VLM indicates the OCR text. 通过 OCR 识别到'"
    for p, r in T.INTERNAL_TERMS:
        x = f"regexp_replace({x}, '(?i){p}', '{r}', 'g')"
    return f"SELECT doc_id, md5(trim({x})) AS clean FROM documents"


@query(_sanitize_sql())
def sanitize_terms(spark, d):
    x = F.concat(F.lit("OCR shows "), F.replace("text", F.lit(" the "), F.lit(" detected by OCR ")), F.lit(" VLM indicates the OCR text. 通过 OCR 识别到"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.sanitize_terms(x)).alias("clean"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace('<think>' || substr(text, 1, 50) || '</thinking>' || replace(text, '. ', '<THINKING>x' || chr(10) || '</Think>. '), '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g'), '^\s+|\s+$', '', 'g')) AS answer FROM documents")
def strip_thinking(spark, d):
    x = F.concat(F.lit("<think>"), F.substring("text", 1, 50), F.lit("</thinking>"), F.replace("text", F.lit(". "), F.lit("<THINKING>x\n</Think>. ")))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_thinking(x)).alias("answer"))


@query(r"""WITH p AS (SELECT page_id, replace(html, '<p>', '![a](/pics/' || page_id || '_1.png?x=1)<img alt="" src="b/Manual' || (page_id % 7) || '.v2.jpg">[PIC:drill0_' || (page_id % 5) || ']') AS t FROM pages),
m AS (SELECT page_id, list_concat(list_concat(regexp_extract_all(t, '!\[[^\]]*\]\(([^)]+)\)', 1), regexp_extract_all(t, '(?i)<img[^>]+src=["'']([^"'']+)["''][^>]*>', 1)), regexp_extract_all(t, '[<\[]PIC[:：]([A-Za-z0-9_\-]+)[>\]]', 1)) AS ids FROM p),
u AS (SELECT page_id, unnest(ids) AS x, generate_subscripts(ids, 1) AS n FROM m), s AS (SELECT page_id, n, regexp_replace(regexp_extract(regexp_replace(trim(x), '[?#].*', ''), '([^/]*)/*$', 1), '\.[^.]*$', '') AS id FROM u), f AS (SELECT page_id, id, min(n) AS n FROM s GROUP BY ALL)
SELECT page_id, string_agg(id, ',' ORDER BY n) AS ids FROM f GROUP BY page_id""")
def extract_image_ids(spark, d):
    put = F.concat(F.lit("![a](/pics/"), "page_id", F.lit('_1.png?x=1)<img alt="" src="b/Manual'), F.col("page_id") % 7, F.lit('.v2.jpg">[PIC:drill0_'), F.col("page_id") % 5, F.lit("]"))
    x = table(spark, d, "pages").select("page_id", T.image_ids(F.replace("html", F.lit("<p>"), put)).alias("ids"))
    return x.where(F.size("ids") > 0).select("page_id", F.array_join("ids", ",").alias("ids"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 <> 2 AS parsed FROM events""")
def json_fence_parse(spark, d):
    """Objects inside code fences or prose are found; broken ones are null."""
    e = table(spark, d, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.concat(F.lit("no "), F.replace("props", F.lit("{"), F.lit("("))))
    x = e.select("event_id", T.json_fence(t).alias("j"))
    return x.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.try_parse_json("j").isNotNull().alias("parsed"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k, event_id % 4 < 3 AS found FROM events""")
def json_first_object(spark, d):
    """The first object that decodes, behind braces that do not, inside an unclosed one
    and in a fence."""
    e, kind = table(spark, d, "events"), F.col("event_id") % 4
    t = F.when(kind == 0, F.concat(F.lit("{"), "event_type", F.lit("} then "), "props", F.lit(' and {"k": 0}'))).when(kind == 1, F.concat(F.lit('so: {"a": {"b": "}" '), "props"))
    t = t.when(kind == 2, F.concat(F.lit("<think>{}</think>```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("no "), F.replace("props", F.lit("}"), F.lit(")"))))
    x = e.select("event_id", T.first_object(t).alias("j"))
    return x.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.col("j").isNotNull().alias("found"))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'customer_service' ELSE event_type END AS intent, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 50 END AS conf FROM events)
SELECT event_id, CASE WHEN intent IN ('manual', 'customer_service') THEN intent END AS intent, round(least(greatest(coalesce(conf, 0), 0), 1), 6) AS confidence, event_id % 4 <> 0 AS sufficient FROM c""")
def parse_route_plan(spark, d):
    """Typed fields with defaults out of a model's JSON reply."""
    e = table(spark, d, "events")
    intent = F.when(F.col("event_type") == "click", "manual").when(F.col("event_type") == "view", "customer_service").otherwise(F.col("event_type"))
    reply = F.to_json(F.struct(intent.alias("intent"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 50).alias("confidence"), F.when(F.col("event_id") % 4 != 0, True).alias("sufficient")))
    x = e.select("event_id", F.from_json(T.json_fence(F.concat(F.lit("```json\n"), reply, F.lit("\n```"))), "intent string, confidence double, sufficient boolean").alias("r"))
    known = F.when(F.col("r.intent").isin("manual", "customer_service"), F.col("r.intent"))
    conf = F.least(F.greatest(F.coalesce("r.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return x.select("event_id", known.alias("intent"), F.round(conf, 6).alias("confidence"), F.coalesce("r.sufficient", F.lit(False)).alias("sufficient"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN to_json(text)::VARCHAR || ',' || to_json(['img' || doc_id])::VARCHAR WHEN 1 THEN to_json(text)::VARCHAR || ',' || to_json(lang)::VARCHAR ELSE to_json(lang)::VARCHAR || ',[]' END AS ret FROM documents""")
def ret_format(spark, d):
    """Manual, customer and mixed layouts of an answer row."""
    kind = F.col("doc_id") % 3
    text, lang = T.json_string(F.col("text")), T.json_string(F.col("lang"))
    ret = F.when(kind == 0, F.concat(text, F.lit(","), F.to_json(F.array(F.concat(F.lit("img"), "doc_id"))))).when(kind == 1, F.concat(text, F.lit(","), lang)).otherwise(F.concat(lang, F.lit(",[]")))
    return table(spark, d, "documents").select("doc_id", ret.alias("ret"))


@query("""WITH c AS (SELECT o_custkey, string_agg('| ' || o_orderkey || ' | ' || replace(o_orderpriority, '-', '\\|') || ' | ' || coalesce(nullif(o_orderstatus, 'F'), '') || ' |', chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY 1)
SELECT o_custkey, md5('| key | priority | status |' || chr(10) || '| --- | --- | --- |' || chr(10) || body) AS md FROM c""")
def md_table_build(spark, d):
    """Markdown table per customer, pipes escaped, missing cells empty."""
    row = F.concat(F.lit("| "), "o_orderkey", F.lit(" | "), F.replace("o_orderpriority", F.lit("-"), F.lit("\\|")), F.lit(" | "), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("")), F.lit(" |"))
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", row.alias("r")).groupBy("o_custkey")
    x = x.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda s: s["r"]), "\n").alias("body"))
    return x.select("o_custkey", F.md5(F.concat(F.lit("| key | priority | status |\n| --- | --- | --- |\n"), "body")).alias("md"))


@query("""SELECT doc_id, md5(CASE lang WHEN 'en' THEN 'Image: ' || coalesce(nullif(source, ''), 'None') || chr(10) || 'Description: ' || text WHEN 'de' THEN 'Table: ' || source || chr(10) || text ELSE 'Equation: ' || text || chr(10) || 'Number: ' || doc_id END) AS chunk FROM documents""")
def modal_chunk_text(spark, d):
    nl = F.lit("\n")
    image = F.concat(F.lit("Image: "), F.coalesce(F.nullif("source", F.lit("")), F.lit("None")), nl, F.lit("Description: "), "text")
    other = F.when(F.col("lang") == "de", F.concat(F.lit("Table: "), "source", nl, "text")).otherwise(F.concat(F.lit("Equation: "), "text", nl, F.lit("Number: "), "doc_id"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.when(F.col("lang") == "en", image).otherwise(other)).alias("chunk"))
