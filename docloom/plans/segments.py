"""Registered queries on word segmentation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import segment
from docloom.plans.registry import register
from docloom.plans.retrieval import TOKENS
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

#: Words of a clause, and longest word of the lexicon, of the registered query.
WORDS, LONGEST = 12, 8


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, {TOKENS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w), {WORDS})) AS k FROM t),
c AS MATERIALIZED (SELECT doc_id, k, w[k + 1:k + {WORDS}] AS w, array_to_string(w[k + 1:k + {WORDS}], '') AS clause FROM p),
lex AS (SELECT word, count(*) AS uses FROM (SELECT unnest(w) AS word FROM t) WHERE length(word) <= {LONGEST} GROUP BY word),
tot AS (SELECT sum(uses) AS n FROM lex),
cost AS MATERIALIZED (SELECT word, round(1e6 * (ln(n) - ln(uses)))::BIGINT AS c FROM lex, tot),
unk AS (SELECT round(1e6 * ln(n * 2.0))::BIGINT AS c FROM tot),
d AS MATERIALIZED (SELECT DISTINCT clause FROM c),
starts AS (SELECT clause, unnest(range(1, length(clause) + 1)) AS i FROM d),
sub AS (SELECT clause, i, unnest(range(1, least({LONGEST}, length(clause) - i + 1) + 1)) AS s FROM starts),
arcs AS (SELECT clause, i, s, coalesce(cost.c, unk.c) AS c FROM sub CROSS JOIN unk LEFT JOIN cost ON word = substr(clause, i, s) WHERE cost.c IS NOT NULL OR s = 1),
node AS (SELECT clause, i, list({{'s': s, 'c': c}}) AS a FROM arcs GROUP BY clause, i),
lat AS (SELECT clause, list({{'a': a, 'best': CAST([] AS BIGINT[]), 'size': CAST([] AS BIGINT[])}} ORDER BY i DESC) AS nodes FROM node GROUP BY clause),
walked AS (SELECT clause, list_reduce(list_prepend({{'a': nodes[1].a, 'best': [0::BIGINT], 'size': CAST([] AS BIGINT[])}}, nodes), lambda acc, x: {{'a': x.a,
  'best': list_prepend(list_sort(list_transform(x.a, lambda y: {{'c': acc.best[y.s] + y.c, 's': -y.s}}))[1].c, acc.best),
  'size': list_prepend(-list_sort(list_transform(x.a, lambda y: {{'c': acc.best[y.s] + y.c, 's': -y.s}}))[1].s, acc.size)}}).size AS size FROM lat),
ended AS MATERIALIZED (SELECT clause, list_reduce(list_prepend({{'p': 0::BIGINT, 'next': 1::BIGINT, 'ends': CAST([] AS BIGINT[])}}, list_transform(range(1, len(size) + 1), lambda i: {{'p': i, 'next': size[i], 'ends': CAST([] AS BIGINT[])}})),
  lambda acc, x: CASE WHEN x.p = acc.next THEN {{'p': x.p, 'next': x.p + x.next, 'ends': list_append(acc.ends, x.p + x.next - 1)}} ELSE {{'p': x.p, 'next': acc.next, 'ends': acc.ends}} END).ends AS ends FROM walked),
cut AS (SELECT doc_id, k, len(w) AS n_words, len(ends) AS n_cut, len(list_intersect(ends, list_transform(range(1, len(w) + 1), lambda j: length(array_to_string(w[1:j], ''))))) AS n_agree,
  array_to_string(list_transform(range(1, len(ends) + 1), lambda j: substr(clause, CASE WHEN j = 1 THEN 1 ELSE ends[j - 1] + 1 END, ends[j] - CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END)), ' ') AS words FROM c JOIN ended USING (clause))
SELECT doc_id, sum(n_words)::BIGINT AS n_words, sum(n_cut)::BIGINT AS n_cut, sum(n_agree)::BIGINT AS n_agree, md5(string_agg(words, ' ' ORDER BY k)) AS digest FROM cut GROUP BY doc_id""")
def segment_words(spark, d):
    """Texts without their spaces, a dozen words at a time, cut again by a lexicon
    counted from the corpus; ``n_agree`` of ``n_words`` word ends are found."""
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(WORDS)))
    groups = F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("w", k + 1, WORDS).alias("w")))  # a row has its own words only, not its document's
    c = t.select("doc_id", F.explode_outer(groups).alias("g")).where("g is not null").select("doc_id", "g.k", "g.w").withColumn("clause", F.array_join("w", ""))
    lexicon = segment.counted(t.select(F.explode("w").alias("word")).where(F.length("word") <= LONGEST))
    done = c.join(segment.cut(c, lexicon, longest=LONGEST), "clause")
    ends = lambda w: F.aggregate(w, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1)), F.lit(0)) + F.length(x))))
    agree = F.size(F.array_intersect(ends(F.col("w")), ends(F.col("words")))).cast("long")
    rows = done.select("doc_id", "k", F.size("w").cast("long").alias("n_words"), F.size("words").cast("long").alias("n_cut"), agree.alias("n_agree"), F.array_join("words", " ").alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ")
    return rows.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_cut").alias("n_cut"), F.sum("n_agree").alias("n_agree"), F.md5(text).alias("digest"))


LETTERS = "[a-zäöüßéèêçáíóúñ]+"


@query(f"""WITH r AS (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')), '{LETTERS}')) AS run FROM conversations),
rr AS MATERIALIZED (SELECT run, count(*) AS times FROM r GROUP BY run), starts AS (SELECT *, unnest(range(1, length(run) + 1)) AS i FROM rr),
g AS (SELECT *, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS s FROM starts),
k AS MATERIALIZED (SELECT substr(run, i, s) AS word, s, sum(times) AS uses, count(DISTINCT CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '^' || run END) > 1 AND count(DISTINCT CASE WHEN i + s <= length(run) THEN substr(run, i + s, 1) ELSE '$' || run END) > 1 AS free FROM g GROUP BY ALL),
c AS (SELECT word, uses, s, unnest(range(1, s)) AS cut FROM k WHERE s > 1 AND uses >= 3 AND free),
h AS (SELECT c.word, c.uses, max(a.uses::DOUBLE * b.uses) AS chance FROM c JOIN k a ON a.word = substr(c.word, 1, cut) JOIN k b ON b.word = substr(c.word, cut + 1) GROUP BY ALL)
SELECT word, uses::BIGINT AS uses FROM k WHERE s = 1 UNION ALL SELECT word, uses::BIGINT FROM h WHERE uses * (SELECT sum(uses) FROM k WHERE s = 1)::DOUBLE >= 8.0 * chance""")
def mine_words(spark, d):
    """Words of texts that have lost their spaces, found by cohesion and freedom."""
    c = table(spark, d, "conversations").select(F.lower(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", "")).alias("text"))
    return segment.mined(c, run=LETTERS)
