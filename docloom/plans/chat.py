"""Registered conversation queries.

The synthetic conversations hold no words of the fixed term lists, so the rules
run here with frequent words of their four languages as terms, and once more with
the fixed lists on texts that phrases are put in front of.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chat
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

MANUAL, CUSTOMER, PURCHASE = ["the of", "die ", " qui "], ["tion", "heit", "eux", "ción"], ["ent", "ung", "ou"]


def _has(terms, col="text"):
    return "(" + " OR ".join(f"contains(lower({col}), '{t}')" for t in terms) + ")"


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seen FROM conversations)
SELECT conv_id, turn, role, text FROM s WHERE seen < 2 OR (seen = 2 AND role = 'user')""")
def last_n_user_turns(spark, d):
    return chat.last_user_turns(table(spark, d, "conversations"), 2)


@query("""WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(prev, 'tion') AND contains(text, 'ent') AND NOT contains(text, 'tion') THEN 'when does tion arrive?' WHEN contains(prev, 'ung') AND contains(text, 'heit') AND NOT contains(text, 'ung') THEN 'which ung is needed?'
WHEN contains(prev, 'ou') AND contains(prev, 'eau') AND contains(text, 'eux') AND NOT contains(text, 'ou') THEN 'can ou be made anew?' ELSE md5(text) END AS repaired FROM p""")
def lag_turn_repair(spark, d):
    """A turn that leaves out what the turn before named is put in full."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev, has = F.lag("text").over(w), F.contains
    rule = lambda a, b: has(F.col("prev"), F.lit(a)) & has(F.col("text"), F.lit(b)) & ~has(F.col("text"), F.lit(a))
    fixed = F.when(rule("tion", "ent"), "when does tion arrive?").when(rule("ung", "heit"), "which ung is needed?").when(rule("ou", "eux") & has(F.col("prev"), F.lit("eau")), "can ou be made anew?")
    return table(spark, d, "conversations").withColumn("prev", prev).select("conv_id", "turn", fixed.otherwise(F.md5("text")).alias("repaired"))


TASKS = """tasks AS (SELECT conv_id, turn // 2 AS turn_index, turn AS task_id, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS answer, ['img' || (turn % 3), 'img' || (conv_id % 2)] AS image_ids, role AS agent FROM conversations)"""


def _tasks(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("turn_index"), F.col("turn").alias("task_id"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("answer"),
        F.array(F.concat(F.lit("img"), F.col("turn") % 3), F.concat(F.lit("img"), F.col("conv_id") % 2)).alias("image_ids"), F.col("role").alias("agent"),
    )


@query(f"""WITH {TASKS}, i AS (SELECT conv_id, turn_index, img, min(task_id * 10 + pos) AS seq FROM (SELECT conv_id, turn_index, task_id, unnest(image_ids) AS img, generate_subscripts(image_ids, 1) AS pos FROM tasks) GROUP BY ALL),
g AS (SELECT conv_id, turn_index, list(img ORDER BY seq) AS image_ids FROM i GROUP BY ALL)
SELECT conv_id, turn_index, coalesce(string_agg(answer, chr(10) ORDER BY task_id) FILTER (answer <> ''), '') AS answer, array_to_string(any_value(g.image_ids), ',') AS image_ids, CASE WHEN count(DISTINCT agent) = 1 THEN max(agent) ELSE 'mixed' END AS agent
FROM tasks JOIN g USING (conv_id, turn_index) GROUP BY conv_id, turn_index""")
def turn_rollup(spark, d):
    return chat.rollup(_tasks(spark, d), ["conv_id", "turn_index"]).withColumn("image_ids", F.array_join("image_ids", ","))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
s AS (SELECT *, trim(regexp_replace(trim(line), ',$', '')) AS t FROM l), u AS (SELECT *, trim(replace(CASE WHEN length(t) >= 2 AND t[1] = '"' AND t[-1] = '"' THEN substr(t, 2, length(t) - 2) ELSE t END, '""', '"')) AS q FROM s)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS turn_index, q AS question FROM u WHERE q <> ''""")
def split_turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.turns(F.col("text"))).alias("turn_index", "question")).withColumn("turn_index", F.col("turn_index").cast("long"))


@query(r"""WITH s AS (SELECT conv_id, turn, '  "' || replace(text, ' de ', ' "" ') || '", ' AS raw FROM conversations), a AS (SELECT *, trim(raw, ' ' || chr(10)) AS t FROM s), b AS (SELECT *, CASE WHEN ends_with(t, ',') THEN trim(t[:-2], ' ' || chr(10)) ELSE t END AS v FROM a)
SELECT conv_id, turn, md5(trim(replace(v[2:-2], '""', '"'), ' ' || chr(10))) AS cleaned FROM b""")
def clean_turn(spark, d):
    raw = F.concat(F.lit('  "'), F.replace("text", F.lit(" de "), F.lit(' "" ')), F.lit('", '))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.clean_turn(raw)).alias("cleaned"))


@query(rf"""WITH s AS (SELECT conv_id, turn, text, unnest(regexp_split_to_array(text, '(?i)also|thth|[?.;,]')) AS seg, generate_subscripts(regexp_split_to_array(text, '(?i)also|thth|[?.;,]'), 1) AS n FROM conversations WHERE {_has(MANUAL)} AND {_has(CUSTOMER)}),
c AS (SELECT conv_id, turn, n, trim(regexp_replace(trim(seg, ' ' || chr(10)), '^[ ,.;]+|[ ,.;]+$', '', 'g'), ' ') AS q FROM s),
k AS (SELECT conv_id, turn, n, q || '?' AS q FROM c WHERE q <> '' AND {_has(MANUAL, 'q')}), f AS (SELECT conv_id, turn, q, min(n) AS n FROM k GROUP BY ALL)
SELECT conv_id, turn, q AS clause, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS pos FROM f""")
def clause_extract(spark, d):
    c = table(spark, d, "conversations")
    x = chat.clauses(F.col("text"), MANUAL, CUSTOMER, ["also", "thth"])
    return c.select("conv_id", "turn", F.posexplode(x).alias("pos", "clause")).withColumn("pos", F.col("pos").cast("long"))


#: What questions ask in the words of the fixed lists, put in front of the texts.
PHRASES = ["如何安装滤网，另外发票怎么开", "我收到的商品有划痕，要求退款", "Your return policy and ALSO how to install it and also use the filter;", "troubleshooting steps", "退货 and also 运费"]


def _phrased():
    return F.concat(F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % 5 + 1).cast("int")), F.lit(" "), F.col("text"))


def _phrased_sql():
    return "[" + ", ".join(f"'{p}'" for p in PHRASES) + "][1 + conv_id % 5] || ' ' || text"


def _cut_sql(text):
    for word in chat.SEPARATORS:
        text = f"regexp_replace({text}, '(?i){word}', chr(1), 'g')"
    return f"string_split(regexp_replace({text}, '[？?。.;；,，]', chr(1), 'g'), chr(1))"


_EDGE = "^[ ，,。.;；]+|[ ，,。.;；]+$"


@query(rf"""WITH p AS (SELECT conv_id, turn, {_phrased_sql()} AS text FROM conversations), a AS (SELECT *, {_cut_sql("text")} AS segs FROM p WHERE {_has(chat.CLAUSE_MANUAL_TERMS)} AND {_has(chat.CLAUSE_CUSTOMER_TERMS)}),
s AS (SELECT conv_id, turn, unnest(segs) AS seg, generate_subscripts(segs, 1) AS n FROM a), c AS (SELECT conv_id, turn, n, regexp_replace(trim(seg, ' ' || chr(10)), '{_EDGE}', '', 'g') AS q FROM s),
k AS (SELECT conv_id, turn, n, q || CASE WHEN regexp_matches(q, '[\x{{4e00}}-\x{{9fff}}]') THEN '？' ELSE '?' END AS q FROM c WHERE q <> '' AND {_has(chat.CLAUSE_MANUAL_TERMS, 'q')}), f AS (SELECT conv_id, turn, q, min(n) AS n FROM k GROUP BY ALL)
SELECT conv_id, turn, q AS clause, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS pos FROM f""")
def clause_extract_fixed_terms(spark, d):
    """The fixed terms and separators, on texts that hold them."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(chat.clauses(_phrased())).alias("pos", "clause")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH p AS (SELECT conv_id, turn, {_phrased_sql()} AS text FROM conversations), r AS (SELECT *, {_has(chat.CUSTOMER_TERMS)} AND (NOT {_has(chat.MANUAL_TERMS)} OR {_has(chat.PURCHASE_TERMS)}) OR conv_id < 64 AS rule FROM p)
SELECT conv_id, turn, rule AS customer_service, CASE WHEN conv_id < 64 OR turn % 3 = 2 OR (rule AND turn % 3 = 0) THEN CASE WHEN rule THEN 'customer_service' ELSE 'manual' END ELSE CASE turn % 3 WHEN 0 THEN 'manual' ELSE 'customer_service' END END AS route FROM r""")
def rule_intent_fixed_terms(spark, d):
    """The rule and its arbitration with the fixed terms, on texts that hold them."""
    rule = chat.rule_customer_service(_phrased(), F.col("conv_id").cast("string"))
    intent = F.when(F.col("turn") % 3 == 0, "manual").when(F.col("turn") % 3 == 1, "customer_service")
    route = chat.arbitrate(rule, F.col("conv_id") < 64, intent, F.lit(0.9))
    return table(spark, d, "conversations").select("conv_id", "turn", rule.alias("customer_service"), route.alias("route"))


COV = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-zA-Z0-9]+'), lambda t: length(t) >= 2))"


@query(f"""WITH p AS (SELECT conv_id, turn, {COV.format('text')} AS c, {COV.format("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS p FROM conversations)
SELECT conv_id, turn, len(c) AS n_tokens, len(c) = 0 OR len(list_intersect(c, p)) >= greatest(1, least(3, len(c))) AS covered FROM p WHERE p IS NOT NULL""")
def token_coverage(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null")
    return c.select("conv_id", "turn", F.size(T.coverage_tokens(F.col("text"))).cast("long").alias("n_tokens"), T.covers(F.col("text"), F.col("prev")).alias("covered"))


RULE = f"(coalesce(try_cast(CASE WHEN conv_id % 4 = 0 THEN 'x' || conv_id ELSE conv_id::VARCHAR END AS INT) < 64, false) OR ({_has(CUSTOMER)} AND (NOT {_has(MANUAL)} OR {_has(PURCHASE)})))"


def _rule():
    ident = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("x"), "conv_id")).otherwise(F.col("conv_id").cast("string"))
    return chat.rule_customer_service(F.col("text"), ident, MANUAL, CUSTOMER, PURCHASE)


@query(f"SELECT conv_id, turn, {RULE} AS customer_service FROM conversations")
def rule_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", _rule().alias("customer_service"))


@query(f"""WITH r AS (SELECT conv_id, turn, {RULE} AS rule, conv_id < 64 AS strong, CASE turn % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'customer_service' END AS intent, (length(text) % 100) / 100.0 AS conf FROM conversations)
SELECT conv_id, turn, CASE WHEN strong OR intent IS NULL OR conf < 0.55 OR (rule AND intent <> 'customer_service') THEN CASE WHEN rule THEN 'customer_service' ELSE 'manual' END ELSE intent END AS route FROM r""")
def route_arbitrate(spark, d):
    intent = F.when(F.col("turn") % 3 == 0, "manual").when(F.col("turn") % 3 == 1, "customer_service")
    conf = (F.length("text") % 100) / 100.0
    return table(spark, d, "conversations").select("conv_id", "turn", chat.arbitrate(_rule(), F.col("conv_id") < 64, intent, conf).alias("route"))


@query("""WITH tasks AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN role WHEN conv_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations)
SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN max(role) ELSE 'mixed' END AS agent,
CASE WHEN count(DISTINCT role) <> 1 THEN 'mixed_orchestration' WHEN max(role) = 'assistant' THEN 'agentic_retrieval' WHEN bool_or(turn % 3 = 1) THEN 'customer_qa_retrieval' ELSE 'direct_llm' END AS route FROM tasks GROUP BY conv_id""")
def agent_summary(spark, d):
    """All turns are tasks; two conversations in five are made of one agent's."""
    agent = F.when(F.col("conv_id") % 5 == 0, F.col("role")).when(F.col("conv_id") % 2 == 0, "user").otherwise("assistant")
    c = table(spark, d, "conversations").withColumn("role", agent).groupBy("conv_id").agg(F.count_distinct("role").alias("n"), F.max("role").alias("one"), F.bool_or(F.col("turn") % 3 == 1).alias("hit"))
    route = F.when(F.col("n") != 1, "mixed_orchestration").when(F.col("one") == "assistant", "agentic_retrieval").when(F.col("hit"), "customer_qa_retrieval").otherwise("direct_llm")
    return c.select("conv_id", F.when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("agent"), route.alias("route"))
