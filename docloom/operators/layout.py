"""Page geometry over block rows with columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import checkpoint

#: Fixed values.
MATH_OPERATORS = "=+-<>^_×÷−·∑∏∫√≈≠≤≥"


def union_box(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def overlap(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def share_inside(a: str, b: str) -> Column:
    """Share of box a's area (at least 1) inside box b."""
    area = (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))
    return overlap(a, b) / F.greatest(area, F.lit(1.0))


def outside(blocks: DataFrame, containers: DataFrame, page: str, least: float = 0.6) -> DataFrame:
    """Blocks not mostly inside any container of their page."""
    a, b = blocks.alias("a"), containers.alias("b")
    return a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & (share_inside("a", "b") >= least), "left_anti")


def nearest_caption(items: DataFrame, captions: DataFrame, page: str, reach: float = 140.0, tolerance: float = 2.0) -> DataFrame:
    """``items(id, kind, page, box)`` with the nearest caption of the page: images
    look below first, tables above first."""
    a, b = items.alias("a"), captions.alias("b")
    j = a.join(b, F.col(f"a.{page}") == F.col(f"b.{page}"))
    below = F.col("b.y0") >= F.col("a.y1") - tolerance
    above = ~below & (F.col("b.y1") <= F.col("a.y0") + tolerance)
    gap = F.when(below, F.greatest(F.col("b.y0") - F.col("a.y1"), F.lit(0.0))).when(above, F.greatest(F.col("a.y0") - F.col("b.y1"), F.lit(0.0)))
    wanted = F.when(F.col("a.kind") == "image", below).otherwise(above)
    j = j.withColumn("gap", gap).where(F.col("gap") <= reach).withColumn("second", F.when(wanted, 0).otherwise(1))
    best = j.groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct("second", "gap", F.col("b.id").alias("caption_id"))).alias("m"))
    return best.select("id", "m.caption_id", F.round("m.gap", 3).alias("gap"), (F.col("m.second") == 1).alias("fallback"))


def caption_between(items: DataFrame, captions: DataFrame, page: str, side: str, reach: float, tolerance: float = 2.0) -> DataFrame:
    """Each item's nearest caption of the page that lies ``below`` it (within
    180 points, usually) or ``above`` it (40), overlapping by ``tolerance`` at most."""
    a, b = items.alias("a"), captions.alias("b")
    gap = F.col("b.y0") - F.col("a.y1") if side == "below" else F.col("a.y0") - F.col("b.y1")
    j = a.join(b, F.col(f"a.{page}") == F.col(f"b.{page}")).withColumn("gap", gap).where((F.col("gap") >= -tolerance) & (F.col("gap") <= reach))
    best = j.groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct("gap", F.col("b.id").alias("caption_id"))).alias("m"))
    return best.select("id", F.lit(side).alias("side"), "m.caption_id", F.round("m.gap", 3).alias("gap"))


def band_join(fragments: DataFrame, anchors: DataFrame, page: str, reach: float = 22.0) -> DataFrame:
    """Each fragment's nearest anchor by vertical centre within the band.  The
    centre is bucketed by the band's width, so the join is an equi-join of a
    fragment with three buckets."""
    mid = (F.col("y0") + F.col("y1")) / 2
    a = anchors.select(F.col(page).alias("_p"), F.col("id").alias("anchor_id"), mid.alias("_m"), F.floor(mid / reach).alias("_b"))
    f = fragments.withColumn("_y", mid).withColumn("_k", F.explode(F.sequence(F.floor(F.col("_y") / reach) - 1, F.floor(F.col("_y") / reach) + 1)))
    j = f.join(a, (F.col(page) == F.col("_p")) & (F.col("_k") == F.col("_b"))).withColumn("gap", F.abs(F.col("_y") - F.col("_m"))).where(F.col("gap") <= reach)
    best = j.groupBy("id").agg(F.min(F.struct("gap", "anchor_id")).alias("m"))
    return best.select("id", "m.anchor_id", F.round("m.gap", 3).alias("gap"))


def vertical_groups(boxes: DataFrame, page: str, gap: float = 12.0) -> DataFrame:
    """Boxes by (y0, x0); a new group begins below all before it by the gap."""
    w = Window.partitionBy(page).orderBy("y0", "x0", "id")
    low = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("y0") > low + gap, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(blocks: DataFrame, page: str, centre: float, tolerance: float = 2.0) -> DataFrame:
    """Two-column order: left then right blocks that end above the next
    full-width block, then that block.  A column waits at its first block that
    reaches below the boundary, so the running maximum of bottoms decides."""
    cx = F.lit(centre)
    side = F.when((F.col("x0") < cx) & (cx < F.col("x1")), 0).when((F.col("x0") + F.col("x1")) / 2 < cx, 1).otherwise(2)
    b = blocks.withColumn("side", side)
    by = [F.round("y0", 1), F.round("x0", 1), F.col("kind"), F.col("id")]
    w = Window.partitionBy(page, "side").orderBy(*by)
    b = b.withColumn("low", F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    span = b.where("side = 0").groupBy(F.col(page).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("n", (F.col("y0") + tolerance).alias("edge")))).alias("edges"))
    b = b.join(span, F.col(page) == F.col("_p"), "left")
    band = F.when(F.col("side") == 0, F.col("n")).otherwise(F.coalesce(F.try_element_at(F.filter("edges", lambda e: e["edge"] >= F.col("low")), F.lit(1))["n"], F.lit(1 << 30)))
    b = b.withColumn("band", band)
    last = F.when(F.col("side") == 0, 3).otherwise(F.col("side"))
    o = Window.partitionBy(page).orderBy("band", last, "n")
    return b.withColumn("pos", F.row_number().over(o) - 1)


def horizontal(lines: Column) -> Column:
    """Whether half or more of a block's lines, an array of ``(dx, dy)`` writing
    directions, run along the page; a block that tells no lines counts as such."""
    along = F.size(F.filter(lines, lambda v: (F.abs(v["dx"]) >= 0.9) & (F.abs(v["dy"]) <= 0.1)))
    n = F.coalesce(F.size(lines), F.lit(0))
    return (n <= 0) | (along >= F.greatest(F.lit(1), F.floor(n / 2)))


def looks_like_equation(text: Column, math_ratio: Column) -> Column:
    signs = F.length(text) - F.length(F.translate(text, MATH_OPERATORS, ""))
    words = F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    yes = text.rlike(r"^\d+(\.\d+)?\z") & (F.length(text) <= 4) | (math_ratio >= 0.2) | (signs >= 1) & (words <= 4) | (F.length(text) <= 12) & text.rlike(r"[\[\]{}()]")
    return F.coalesce((text != "") & (F.length(text) <= 240) & yes, F.lit(False))


def display_equation(text: Column, math_ratio: Column, x0: Column, x1: Column, left: float, right: float) -> Column:
    """Whether an unnumbered fragment is set as an equation of its own: centred in
    its column (or the page, if it crosses the middle), narrow, of few words."""
    width, middle = right - left, (left + right) / 2
    crosses = (x0 < middle) & (x1 > middle)
    centre = (x0 + x1) / 2
    target = F.when(crosses, middle).when(centre < middle, left + width * 0.25).otherwise(left + width * 0.75)
    reach = F.when(crosses, width * 0.2).otherwise(width * 0.15)
    numbered = text.rlike(r"(^|\s)\(\s*\d{1,3}\s*\)\s*\z")
    few = F.regexp_count(text, F.lit("[A-Za-z]{2,}")) <= 4
    return ~numbered & looks_like_equation(text, math_ratio) & (F.abs(centre - target) <= reach) & (x1 - x0 <= width * 0.8) & few


def complete_equation(text: Column, math_characters: Column, characters: Column) -> Column:
    """Whether joined fragments make an equation: an operator, and either a fifth
    of mathematical characters or a name before an equals sign."""
    operator = F.length(F.translate(text, MATH_OPERATORS, "")) < F.length(text)
    return operator & ((math_characters / F.greatest(characters, F.lit(1)) >= 0.2) | text.rlike(r"^[A-Za-z][A-Za-z0-9_ ]{0,40}\s*="))


def touching(boxes: DataFrame, page: str, reach_x: float, reach_y: float, cell: float = 60.0, same: list[str] = ()) -> DataFrame:
    """``(a, b)``, a < b: boxes of one page (and of the same ``same``) with gaps of at
    most the reaches.  Each box is laid on the grid cells that it and its reach cover,
    so boxes meet only where they are near, and a pair counts in the first cell that
    both cover."""
    span = lambda lo, hi, r: F.sequence(F.floor((F.col(lo) - r) / cell), F.floor((F.col(hi) + r) / cell))
    laid = boxes.select(page, "id", "x0", "y0", "x1", "y1", *same, F.explode(span("x0", "x1", reach_x / 2)).alias("cx")).withColumn("cy", F.explode(span("y0", "y1", reach_y / 2)))
    a, b = laid.alias("a"), laid.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page, "cx", "cy", *same)]
    gap = lambda lo, hi: F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) - F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}"))
    near = (gap("x0", "x1") <= reach_x) & (gap("y0", "y1") <= reach_y) & (F.col("a.id") < F.col("b.id"))
    first = lambda lo, r, c: F.col(f"a.{c}") == F.floor((F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) - r) / cell)
    on = near & first("x0", reach_x / 2, "cx") & first("y0", reach_y / 2, "cy")
    for k in keys:
        on = on & k
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, root)`` for ``nodes(id)`` and ``edges(a, b)``: the least id that is
    reached.  Each round takes the least label around and then the label's label, so
    the rounds are about the logarithm of the longest way; labels are checkpointed."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(nodes.select("id", F.col("id").alias("root")).distinct())
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        least = labels.join(around, "id", "left").select("id", "root", F.least("root", F.coalesce("r", "root")).alias("new"))
        hooks = least.groupBy("root").agg(F.min("new").alias("to"))  # a root follows the least label any of its members met
        step = checkpoint(least.join(hooks, "root").select("id", F.least("new", "to").alias("root"), (F.least("new", "to") < F.col("root")).alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("id", "root")
        labels = step.select("id", "root")


def regions(boxes: DataFrame, page: str, reach_x: float, reach_y: float, same: list[str] = ()) -> DataFrame:
    """``(id, region)``: boxes that touch, over any chain of others, are one region,
    named by its least id."""
    found = connected(boxes.select("id"), touching(boxes, page, reach_x, reach_y, same=same))
    return found.select("id", F.col("root").alias("region"))


def _islands(words: DataFrame, table: str, lo: str, hi: str, gap: float, name: str) -> DataFrame:
    """``words`` numbered by the islands of their projections: a new island begins
    beyond all before it by more than ``gap``."""
    w = Window.partitionBy(table).orderBy(lo, hi, "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(lo) > F.max(hi).over(before) + gap, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def grown_table(tables: DataFrame, rules: DataFrame, page: str, above: float = 20.0, below: float = 3.0, share: float = 0.75) -> DataFrame:
    """Table boxes grown by the wide horizontal rules at them: at least ``share`` of
    the table's width, overlapping it, from ``above`` over it to ``below`` under it."""
    t, r = tables.alias("t"), rules.where(F.abs(F.col("y1") - F.col("y0")) <= 1.0).alias("r")
    y = (F.col("r.y0") + F.col("r.y1")) / 2
    wide = F.col("r.x1") - F.col("r.x0") >= share * (F.col("t.x1") - F.col("t.x0"))
    over = F.least("t.x1", "r.x1") > F.greatest("t.x0", "r.x0")
    j = t.join(r, (F.col(f"t.{page}") == F.col(f"r.{page}")) & wide & over & y.between(F.col("t.y0") - above, F.col("t.y1") + below), "left")
    keep = lambda agg, a, b: agg(F.coalesce(b, a))
    g = j.groupBy(F.col("t.id").alias("id"), F.col(f"t.{page}").alias(page), F.col("t.x0").alias("_a"), F.col("t.y0").alias("_b"), F.col("t.x1").alias("_c"), F.col("t.y1").alias("_d")).agg(
        keep(F.min, F.col("t.x0"), F.col("r.x0")).alias("x0"), keep(F.min, F.col("t.y0"), y).alias("y0"), keep(F.max, F.col("t.x1"), F.col("r.x1")).alias("x1"), keep(F.max, F.col("t.y1"), y).alias("y1")
    )
    return g.select("id", page, F.least("_a", "x0").alias("x0"), F.least("_b", "y0").alias("y0"), F.greatest("_c", "x1").alias("x1"), F.greatest("_d", "y1").alias("y1"))


def table_cells(tables: DataFrame, words: DataFrame, rules: DataFrame, page: str, gap_x: float = 6.0, gap_y: float = 1.0) -> DataFrame:
    """``(table, row, col, text)``: the words of each table box in their cells.

    A table's vertical and horizontal rules cut it where it has two or more of a kind
    inside (a word's row is how many rules lie above its middle); else the gaps in the
    projections of its words do.  Words of a cell are joined in reading order.
    """
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    t = tables.select(F.col("id").alias("table"), page, *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = lambda x, y: x.between(F.col("tx0") - 1, F.col("tx1") + 1) & y.between(F.col("ty0") - 1, F.col("ty1") + 1)
    w = words.join(t, page).where(inside(mid("x0", "x1"), mid("y0", "y1"))).select("table", "id", "text", "x0", "y0", "x1", "y1")
    w = _islands(_islands(w, "table", "x0", "x1", gap_x, "_gx"), "table", "y0", "y1", gap_y, "_gy")
    r = rules.join(t, page).where(inside(mid("x0", "x1"), mid("y0", "y1")))
    flat, steep = F.abs(F.col("y1") - F.col("y0")) <= 1.0, F.abs(F.col("x1") - F.col("x0")) <= 1.0
    at = lambda test, lo, hi: F.array_sort(F.collect_set(F.when(test, F.round(mid(lo, hi), 1))))
    cuts = r.groupBy("table").agg(at(steep, "x0", "x1").alias("xs"), at(flat & ~steep, "y0", "y1").alias("ys"))
    w = w.join(cuts, "table", "left")
    ruled = lambda cut, m: F.size(F.filter(cut, lambda c: c < m))
    col = F.when(F.size("xs") > 2, ruled(F.col("xs"), mid("x0", "x1"))).otherwise(F.col("_gx"))
    row = F.when(F.size("ys") > 3, ruled(F.col("ys"), mid("y0", "y1"))).otherwise(F.col("_gy"))
    w = w.select("table", row.alias("_row"), col.alias("_col"), "id", "text", "x0", "y0")
    dense = lambda c, by: F.dense_rank().over(Window.partitionBy("table").orderBy(c)).cast("long") - 1
    w = w.withColumn("row", dense("_row", "table")).withColumn("col", dense("_col", "table"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "id", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("table", "row", "col").agg(text.alias("text"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """``(table, n_rows, n_cols, markdown)``: the first row is the head; empty cells
    stay empty; bars inside cells are escaped."""
    shape = cells.groupBy("table").agg(F.max("row").alias("r"), F.max("col").alias("c"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), F.replace("text", F.lit("|"), F.lit("\\|"))))).alias("m"))
    cell = lambda i, j: F.coalesce(F.try_element_at("m", F.struct(i.alias("row"), j.alias("col"))), F.lit(""))
    line = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c")), lambda j: cell(i, j)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), (F.col("c") + 1).cast("int")), " | "), F.lit(" |"))
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("r")), line)
    lines = F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
    return shape.select("table", (F.col("r") + 1).alias("n_rows"), (F.col("c") + 1).alias("n_cols"), F.array_join(lines, "\n").alias("markdown"))
