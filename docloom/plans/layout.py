"""Registered page-layout queries; boxes are derived from ``events`` by
arithmetic (forty blocks to a page of 600 by 800 points)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import layout as L
from docloom.plans.registry import register
from docloom.session import table

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

BOX = """
box AS (SELECT event_id AS id, event_id // 40 AS page, event_type AS kind, x0, y0, x0 + w AS x1, y0 + h AS y1, value FROM (SELECT *, ((event_id * 37) % 500)::DOUBLE AS x0, ((event_id * 53) % 760)::DOUBLE AS y0,
  (20 + (event_id * 29) % 300)::DOUBLE AS w, (8 + (event_id * 17) % 60)::DOUBLE AS h FROM events)),
img AS (SELECT * FROM box WHERE id % 5 = 0), cap AS (SELECT * FROM box WHERE id % 7 = 1)
"""


def boxes(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(i.alias("id"), F.floor(i / 40).alias("page"), F.col("event_type").alias("kind"), ((i * 37) % 500).cast("double").alias("x0"), ((i * 53) % 760).cast("double").alias("y0"), (20 + (i * 29) % 300).cast("double").alias("w"), (8 + (i * 17) % 60).cast("double").alias("h"), "value")
    return e.select("id", "page", "kind", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "value")


@query(f"WITH {BOX} SELECT page, kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM box GROUP BY page, kind")
def bbox_union(spark, d):
    return L.union_box(boxes(spark, d), ["page", "kind"])


SHARE = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1)"


@query(f"WITH {BOX} SELECT a.id, b.id AS container, round({SHARE}, 6) AS share FROM box a JOIN img b ON a.page = b.page AND a.id <> b.id WHERE {SHARE} >= 0.6")
def bbox_containment(spark, d):
    x = boxes(spark, d)
    j = x.alias("a").join(x.where("id % 5 = 0").alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.id") != F.col("b.id")))
    return j.where(L.share_inside("a", "b") >= 0.6).select(F.col("a.id").alias("id"), F.col("b.id").alias("container"), F.round(L.share_inside("a", "b"), 6).alias("share"))


@query(f"WITH {BOX} SELECT id, page FROM box a WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM img b WHERE a.page = b.page AND {SHARE} >= 0.6)")
def theta_antijoin(spark, d):
    x = boxes(spark, d)
    return L.outside(x.where("id % 5 <> 0"), x.where("id % 5 = 0"), "page").select("id", "page")


@query(f"""WITH {BOX}, j AS (SELECT f.id, a.id AS anchor_id, abs((f.y0 + f.y1) / 2 - (a.y0 + a.y1) / 2) AS gap FROM box f JOIN cap a ON a.page = f.page WHERE f.id % 7 <> 1)
SELECT id, arg_min(anchor_id, gap * 1000000 + anchor_id / 1000000.0) AS anchor_id, round(min(gap), 3) AS gap FROM j WHERE gap <= 22 GROUP BY id""")
def band_join_argmin(spark, d):
    x = boxes(spark, d)
    return L.band_join(x.where("id % 7 <> 1"), x.where("id % 7 = 1"), "page")


@query(f"""WITH {BOX}, j AS (SELECT a.id, CASE WHEN a.id % 2 = 0 THEN 'image' ELSE 'table' END AS k, b.id AS cid, b.y0 >= a.y1 - 2 AS below, NOT (b.y0 >= a.y1 - 2) AND b.y1 <= a.y0 + 2 AS above, b.y0 - a.y1 AS d1, a.y0 - b.y1 AS d2 FROM img a JOIN cap b ON a.page = b.page),
g AS (SELECT *, CASE WHEN below THEN greatest(d1, 0) WHEN above THEN greatest(d2, 0) END AS gap, CASE WHEN (k = 'image' AND below) OR (k = 'table' AND above) THEN 0 ELSE 1 END AS second FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY second, gap, cid) AS rn FROM g WHERE gap <= 140)
SELECT id, cid AS caption_id, round(gap, 3) AS gap, second = 1 AS fallback FROM r WHERE rn = 1""")
def nearest_caption(spark, d):
    x = boxes(spark, d)
    a = x.where("id % 5 = 0").withColumn("kind", F.when(F.col("id") % 2 == 0, "image").otherwise("table"))
    return L.nearest_caption(a, x.where("id % 7 = 1"), "page")


@query(f"""WITH {BOX}, g AS (SELECT a.id, c.id AS cid, 'below' AS side, c.y0 - a.y1 AS gap FROM img a JOIN cap c ON a.page = c.page WHERE c.y0 - a.y1 BETWEEN -2 AND 180
UNION ALL SELECT a.id, c.id, 'above', a.y0 - c.y1 FROM img a JOIN cap c ON a.page = c.page WHERE a.y0 - c.y1 BETWEEN -2 AND 40)
SELECT id, side, cid AS caption_id, round(gap, 3) AS gap FROM g QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY gap, cid) = 1""")
def caption_below_above(spark, d):
    x = boxes(spark, d)
    a, c = x.where("id % 5 = 0"), x.where("id % 7 = 1")
    return L.caption_between(a, c, "page", "below", 180.0).unionByName(L.caption_between(a, c, "page", "above", 40.0))


@query(f"""WITH {BOX}, n AS (SELECT *, CASE WHEN y0 > max(y1) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 THEN 1 ELSE 0 END AS new FROM img)
SELECT id, page, sum(new) OVER (PARTITION BY page ORDER BY y0, x0, id)::BIGINT AS grp FROM n""")
def gap_islands(spark, d):
    return L.vertical_groups(boxes(spark, d).where("id % 5 = 0"), "page").select("id", "page", "grp")


@query(f"""WITH {BOX}, s AS (SELECT *, CASE WHEN x0 < 300 AND 300 < x1 THEN 0 WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END AS side FROM box),
o AS (SELECT *, row_number() OVER w AS n, max(y1) OVER (PARTITION BY page, side ORDER BY round(y0, 1), round(x0, 1), kind, id ROWS UNBOUNDED PRECEDING) AS low FROM s WINDOW w AS (PARTITION BY page, side ORDER BY round(y0, 1), round(x0, 1), kind, id)),
b AS (SELECT o.*, CASE WHEN side = 0 THEN n ELSE coalesce((SELECT min(p.n) FROM o p WHERE p.page = o.page AND p.side = 0 AND p.y0 + 2 >= o.low), 1073741824) END AS band FROM o)
SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN side = 0 THEN 3 ELSE side END, n) - 1 AS pos FROM b""")
def reading_order(spark, d):
    return L.reading_order(boxes(spark, d), "page", 300.0).select("id", "page", F.col("pos").cast("long").alias("pos"))


EQ = """(CASE id % 6 WHEN 0 THEN 'E = mc^2' WHEN 1 THEN '42.5' WHEN 2 THEN 'the value of x = 3 for all of them' WHEN 3 THEN 'f(x)' WHEN 4 THEN 'plain words only here' ELSE '' END)"""


@query(f"""WITH {BOX}, t AS (SELECT id, {EQ} AS t, (id % 10) / 10.0 AS ratio FROM box)
SELECT id, t <> '' AND length(t) <= 240 AND ((length(t) <= 4 AND regexp_full_match(t, '\\d+(\\.\\d+)?')) OR ratio >= 0.2 OR (length(regexp_replace(t, '[^=+<>^_×÷−·∑∏∫√≈≠≤≥-]', '', 'g')) >= 1 AND len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) <= 4) OR (length(t) <= 12 AND regexp_matches(t, '[\\[\\]{{}}()]'))) AS equation FROM t""")
def equation_like(spark, d):
    k = F.col("id") % 6
    t = F.when(k == 0, "E = mc^2").when(k == 1, "42.5").when(k == 2, "the value of x = 3 for all of them").when(k == 3, "f(x)").when(k == 4, "plain words only here").otherwise("")
    return boxes(spark, d).select("id", L.looks_like_equation(t, (F.col("id") % 10) / 10.0).alias("equation"))


@query(f"""WITH {BOX} SELECT page, kind, round(sum(CASE WHEN id % 3 = 0 THEN x1 - x0 ELSE 0 END) / greatest(sum(x1 - x0), 1), 6) AS ratio, md5(string_agg(CASE WHEN id % 4 = 0 THEN '∑' ELSE kind END, ' ' ORDER BY y0, x0, id)) AS text FROM box GROUP BY page, kind""")
def math_ratio(spark, d):
    """Per block: share of characters set in a math font, and its text with the
    font's capital X read as a sum sign."""
    x = boxes(spark, d).withColumn("n", F.col("x1") - F.col("x0")).withColumn("t", F.when(F.col("id") % 4 == 0, "∑").otherwise(F.col("kind")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "id", "t"))), lambda s: s["t"]), " ")
    ratio = F.sum(F.when(F.col("id") % 3 == 0, F.col("n")).otherwise(0.0)) / F.greatest(F.sum("n"), F.lit(1.0))
    return x.groupBy("page", "kind").agg(F.round(ratio, 6).alias("ratio"), F.md5(text).alias("text"))


@query(f"""WITH RECURSIVE {BOX}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.page = b.page AND a.kind = b.kind AND a.id <> b.id
  WHERE greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 4 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 7),
c AS (SELECT id, id AS r FROM box UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a), m AS (SELECT id, min(r) AS region FROM c GROUP BY id)
SELECT region, page, kind, count(*) AS boxes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum(value), 4) AS total FROM m JOIN box USING (id) GROUP BY region, page, kind""")
def box_regions(spark, d):
    """Blocks of one kind that touch over any chain are one region of the page."""
    x = boxes(spark, d)
    j = L.regions(x, "page", 4.0, 7.0, same=["kind"]).join(x, "id")
    return j.groupBy("region", "page", "kind").agg(F.count(F.lit(1)).alias("boxes"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.sum("value"), 4).alias("total"))


#: A page of forty events has one table of three columns and up to nine rows, its
#: words set by the events' values; odd pages have a whole grid of rules, even ones
#: three horizontal rules, the upper of which lies outside the box that was found.
GRID = """
g AS (SELECT event_id AS id, event_id // 40 AS page, event_id % 40 AS n, event_type || '|' || (user_id % 100) AS text, value FROM events),
word AS (SELECT id, page, text, 60 + (n % 3) * 150 + least(value, 20) AS x0, 60 + (n % 3) * 150 + least(value, 20) + 60 AS x1, 112 + (n // 3) * 20 + n % 2 AS y0, 112 + (n // 3) * 20 + n % 2 + 10 AS y1 FROM g),
size AS (SELECT page, 4 + page % 6 AS k FROM g GROUP BY page),
tab AS (SELECT page, page AS id, CASE WHEN page % 2 = 0 THEN 112 ELSE 110 END AS y0, 110 + k * 20 - 2 AS y1, 50 AS x0, 500 AS x1, k FROM size),
hit AS (SELECT tab.page, w.id, text, w.x0, w.x1, w.y0, w.y1, k, (w.x0 + w.x1) / 2 AS mx, (w.y0 + w.y1) / 2 AS my, tab.y1 AS bottom FROM word w JOIN tab USING (page) WHERE (w.y0 + w.y1) / 2 <= CASE WHEN page % 2 = 0 THEN 110 + k * 20 ELSE tab.y1 + 2 END + 1)
"""


@query(f"""WITH {GRID}, isl AS (SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6 THEN 1 ELSE 0 END AS nx,
  CASE WHEN y0 > max(y1) OVER (PARTITION BY page ORDER BY y0, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS ny FROM hit),
num AS (SELECT *, sum(nx) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS UNBOUNDED PRECEDING) AS gx, sum(ny) OVER (PARTITION BY page ORDER BY y0, y1, id ROWS UNBOUNDED PRECEDING) AS gy FROM isl),
cel AS (SELECT page, id, text, x0, y0, CASE WHEN page % 2 = 1 THEN (mx > 50)::INT + (mx > 200)::INT + (mx > 350)::INT ELSE gx END AS c, CASE WHEN page % 2 = 1 THEN floor((my - 110) / 20) ELSE gy END AS r FROM num),
den AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS row, dense_rank() OVER (PARTITION BY page ORDER BY c) - 1 AS col FROM cel),
txt AS (SELECT page, row, col, replace(string_agg(text, ' ' ORDER BY y0, x0, id), '|', '\\|') AS t FROM den GROUP BY page, row, col),
dim AS (SELECT page, max(row) AS r, max(col) AS c FROM txt GROUP BY page),
full_ AS (SELECT dim.page, i.i AS row, string_agg(coalesce(t, ''), ' | ' ORDER BY j.j) AS line FROM dim, unnest(range(0, r + 1)) i(i), unnest(range(0, c + 1)) j(j) LEFT JOIN txt ON txt.page = dim.page AND txt.row = i.i AND txt.col = j.j GROUP BY dim.page, i.i),
md AS (SELECT page, string_agg('| ' || line || ' |' || CASE WHEN row = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(0, c + 1), lambda z: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row) AS markdown FROM full_ JOIN dim USING (page) GROUP BY page)
SELECT page AS "table", r + 1 AS n_rows, c + 1 AS n_cols, md5(markdown) AS markdown FROM dim JOIN md USING (page)""")
def table_grid(spark, d):
    """Words, rules and table boxes of a page to a table in markdown."""
    e = table(spark, d, "events")
    n = F.col("event_id") % 40
    g = e.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 40).alias("page"), n.alias("n"), F.concat_ws("|", "event_type", (F.col("user_id") % 100).cast("string")).alias("text"), F.least("value", F.lit(20.0)).alias("v"))
    x0, y0 = 60 + (F.col("n") % 3) * 150 + F.col("v"), (112 + F.floor(F.col("n") / 3) * 20 + F.col("n") % 2).cast("double")
    words = g.select("id", "page", "text", x0.alias("x0"), (x0 + 60).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1"))
    t = g.select("page").distinct().withColumn("k", 4 + F.col("page") % 6)
    tables = t.select(F.col("page").alias("id"), "page", F.lit(50.0).alias("x0"), F.when(F.col("page") % 2 == 0, 112.0).otherwise(110.0).alias("y0"), F.lit(500.0).alias("x1"), (108 + F.col("k") * 20).cast("double").alias("y1"))
    box = lambda a, b, c, f: F.struct(*[v.cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (a, b, c, f))])
    flat = lambda y: box(F.lit(50), y, F.lit(500), y)
    bottom = 110 + F.col("k") * 20
    whole = F.concat(F.transform(F.sequence(F.lit(0), F.col("k").cast("int")), lambda i: flat(110 + i * 20)), F.transform(F.array(*map(F.lit, (50, 200, 350, 500))), lambda x: box(x, F.lit(110), x, bottom)))
    few = F.array(flat(F.lit(100)), flat(F.lit(130)), flat(bottom))
    rules = t.select("page", F.explode(F.when(F.col("page") % 2 == 1, whole).otherwise(few)).alias("r")).select("page", "r.*")
    out = L.table_markdown(L.table_cells(L.grown_table(tables, rules, "page"), words, rules, "page"))
    return out.select("table", "n_rows", "n_cols", F.md5("markdown").alias("markdown"))
