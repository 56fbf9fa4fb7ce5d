"""Question orchestration as batch data flow.

Questions are rows.  Each step (split, decompose, route, retrieve, plan,
select, answer, roll up) is one pass over all questions at once; the only loop
is the bounded number of planning rounds, which builds the plan.  Models are the
pluggable seams of :mod:`docloom.models`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions import text as T
from docloom.operators import chat, fusion
from docloom.session import checkpoint

ROUNDS, FOLLOW_UPS = 2, 3


def tasks(questions: DataFrame) -> DataFrame:
    """``questions(question_id, question)`` -> one task per cleaned turn:
    ``task_id, question_id, turn_index, turn_total, query``."""
    t = questions.withColumn("_t", T.turns(F.col("question")))
    t = t.select("question_id", F.size("_t").alias("turn_total"), F.posexplode("_t").alias("turn_index", "query"))
    return t.select(F.concat_ws("-", F.col("question_id").cast("string"), F.col("turn_index").cast("string")).alias("task_id"), "question_id", "turn_index", "turn_total", "query")


def _strings(reply) -> Column:
    """A reply's JSON array of strings, trimmed; null if it is none."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```\z", "")
    return F.transform(F.from_json(bare, "array<string>"), lambda x: F.trim(F.coalesce(x, F.lit(""))))


def decomposed(questions: DataFrame, rewriter: M.TextModel, decomposer: M.TextModel) -> DataFrame:
    """Like :func:`tasks`, with turns rewritten and taken apart by models.

    The turns of a question of several are rewritten together; a reply that is
    not as many strings leaves them as they are.  Each turn is taken apart into
    pieces; a reply without any means the turn itself.  What the rules find asked
    about use, in the turn as it was or as rewritten, and no piece covers, is
    added.  Every piece is a task in order, with ``turn``, ``original_query`` and
    ``rewritten_turn`` beside the columns of tasks.
    """
    t = questions.select("question_id", T.turns(F.col("question")).alias("_t"))
    several = F.size("_t") > 1
    t = M.apply_model(t.withColumn("_prompt", F.when(several, F.array_join("_t", "\n"))), "_prompt", "_reply", rewriter).withColumn("_r", _strings(F.col("_reply")))
    new = F.zip_with("_r", "_t", lambda r, o: F.when(r != "", r).otherwise(o))
    t = t.withColumn("_new", F.when(several & (F.size("_r") == F.size("_t")), new).otherwise(F.col("_t")))
    t = t.select("question_id", F.posexplode(F.arrays_zip("_t", "_new")).alias("turn", "_x")).select("question_id", "turn", F.col("_x._t").alias("original_query"), F.col("_x._new").alias("rewritten_turn"))
    t = M.apply_model(t, "rewritten_turn", "_reply", decomposer)
    pieces = F.array_distinct(F.filter(_strings(F.col("_reply")), lambda x: x != ""))
    t = t.withColumn("_p", F.when(F.size(pieces) > 0, pieces).otherwise(F.array("rewritten_turn")))
    asked = F.concat(chat.clauses(F.col("original_query")), chat.clauses(F.col("rewritten_turn")))
    t = t.withColumn("_asked", asked)
    whole = F.aggregate("_asked", F.col("_p"), lambda p, c: F.when(F.exists(p, lambda x: T.covers(c, x)), p).otherwise(F.concat(p, F.array(c))))
    t = t.select("question_id", "turn", "original_query", "rewritten_turn", F.posexplode(whole).alias("_at", "query"))
    own = Window.partitionBy("question_id")
    t = t.withColumn("turn_index", F.row_number().over(own.orderBy("turn", "_at")) - 1).withColumn("turn_total", F.count(F.lit(1)).over(own).cast("int"))
    ident = F.concat_ws("-", F.col("question_id").cast("string"), F.col("turn_index").cast("string"))
    return t.select(ident.alias("task_id"), "question_id", "turn_index", "turn_total", "query", "turn", "original_query", "rewritten_turn")


def routed(task_rows: DataFrame, model: M.TextModel, manual=chat.MANUAL_TERMS, customer=chat.CUSTOMER_TERMS, purchase=chat.PURCHASE_TERMS) -> DataFrame:
    """Tasks with ``sub_agent``: rule and model reply arbitrated."""
    ident = F.col("question_id").cast("string")
    x = M.apply_model(task_rows, "query", "_reply", model)
    x = x.withColumn("_plan", F.from_json(T.first_object(F.col("_reply")), "intent string, confidence double"))
    intent = F.when(F.col("_plan.intent").isin("manual", "customer_service"), F.col("_plan.intent"))
    conf = F.least(F.greatest(F.coalesce("_plan.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rule = chat.rule_customer_service(F.col("query"), ident, manual, customer, purchase)
    strong = F.coalesce(ident.try_cast("int") < 64, F.lit(False))
    return x.withColumn("sub_agent", chat.arbitrate(rule, strong, intent, conf)).drop("_reply", "_plan")


def gather(task_rows: DataFrame, search: Callable[[DataFrame], DataFrame], planner: M.TextModel, rounds: int = ROUNDS) -> DataFrame:
    """Evidence of each task: ``task_id, id, score, text`` and what else the
    search gives.

    ``search(queries(task_id, query))`` gives ``(task_id, id, score, text)``.  A
    planner's reply per task may ask for up to three further queries, twice at
    most; what it cannot say means it is done.  Hits merge by best score.
    """
    queries = task_rows.select("task_id", "query")
    found = checkpoint(search(queries).withColumn("round", F.lit(0)))
    plan = F.from_json(T.first_object(F.col("_reply")), "evidence_sufficient boolean, queries array<string>")
    for r in range(1, rounds + 1):
        seen = found.groupBy("task_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("text"))).alias("_context"))
        prompt = F.concat_ws("\n", F.col("query"), F.coalesce("_context", F.lit("")))
        asked = M.apply_model(task_rows.select("task_id", "query").join(seen, "task_id", "left").withColumn("_prompt", prompt), "_prompt", "_reply", planner).withColumn("_p", plan)
        asked = checkpoint(asked)
        more = asked.where(F.col("_p.queries").isNotNull() & ~F.coalesce("_p.evidence_sufficient", F.lit(False)))
        more = more.select("task_id", F.explode(F.slice(F.array_distinct("_p.queries"), 1, FOLLOW_UPS)).alias("query"))
        found = checkpoint(found.unionByName(search(more).withColumn("round", F.lit(r))))
    w = Window.partitionBy("task_id").orderBy("round", F.desc("score"), "id")
    return fusion.keep_best(found.withColumn("seq", F.row_number().over(w)).withColumn("_k", F.struct("task_id", "id")), "_k", "score", "seq").drop("_k", "seq")


def selected(task_rows: DataFrame, evidence: DataFrame, model: M.TextModel, least: int = 4, most: int = 6) -> DataFrame:
    """The evidence that a model chooses for each task, filled up.

    The reply lists ``selected_chunk_ids``; ids that are no candidates are passed
    over, and a reply that names none means the first ``most``.  Where too few
    are chosen, candidates of the same ``manual`` fill up to ``least`` in order.
    The candidates are a task's best max(2 * most, 12).
    """
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "first_seq")
    c = checkpoint(evidence.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= max(2 * most, 12)))
    row = F.struct("rank", F.col("id").cast("string").alias("id"), "text")
    listed = c.groupBy("task_id").agg(F.array_sort(F.collect_list(row)).alias("_c"))
    lines = F.array_join(F.transform("_c", lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["text"])), "\n")
    x = task_rows.join(listed, "task_id").withColumn("_prompt", F.concat_ws("\n", F.col("query"), lines))
    x = M.apply_model(x.select("task_id", "_c", "_prompt"), "_prompt", "_reply", model)
    asked = F.from_json(T.first_object(F.col("_reply")), "selected_chunk_ids array<string>")["selected_chunk_ids"]
    ids = F.transform("_c", lambda x: x["id"])
    known = F.slice(F.array_intersect(F.coalesce(asked, F.array().cast("array<string>")), ids), 1, most)
    picked = x.select("task_id", F.explode(F.when(F.size(known) > 0, known).otherwise(F.slice(ids, 1, most))).alias("_id"))
    marked = c.withColumn("_id", F.col("id").cast("string")).join(picked.withColumn("chosen", F.lit(True)), ["task_id", "_id"], "left")
    filled = fusion.fill(marked.select("task_id", "id", "manual", "rank", F.coalesce("chosen", F.lit(False)).alias("chosen")), "task_id", least, most)
    return c.join(filled.select("task_id", "id"), ["task_id", "id"], "left_semi").drop("rank")


def answers(task_rows: DataFrame, evidence: DataFrame, model: M.TextModel, top: int = 6) -> DataFrame:
    """``task_id, answer, image_ids``: the best evidence in a prompt, the reply
    cleaned, picture marks resolved from the evidence's images."""
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "first_seq")
    best = evidence.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    rows = F.array_sort(F.collect_list(F.struct("_r", "text")))
    context = best.groupBy("task_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("_context"))
    x = task_rows.join(context, "task_id", "left").withColumn("_prompt", F.concat_ws("\n\n", F.coalesce("_context", F.lit("")), F.col("query")))
    x = M.apply_model(x, "_prompt", "_reply", model)
    x = x.withColumn("_pic", M.picture_tokens_column(T.clean_answer(F.col("_reply")), T.image_ids(F.coalesce("_context", F.lit("")))))
    return x.select("task_id", F.col("_pic.text").alias("answer"), F.col("_pic.image_ids").alias("image_ids"))


def results(task_rows: DataFrame, answered: DataFrame) -> DataFrame:
    """One row per question: turn answers in order, images, agent and route."""
    j = task_rows.join(answered, "task_id").select("question_id", F.col("turn_index").alias("task_id"), "answer", "image_ids", F.col("sub_agent").alias("agent"))
    r = chat.rollup(j, ["question_id"])
    route = F.when(F.col("agent") == "mixed", "mixed_orchestration").when(F.col("agent") == "manual", "agentic_retrieval").otherwise("direct_llm")
    return r.withColumn("route", route)


def fragment_groups(fragments: DataFrame, page: str, gap: float = 7.0, reach: float = 20.0) -> DataFrame:
    """Fragments of one column join the nearest open group: vertical gap at most
    ``gap``, centre at most ``reach`` away.  Order-dependent, so a page is one
    group; a page's fragments are bounded by its size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        out = []
        for r in pdf.sort_values(["y0", "x0", "id"]).itertuples():
            mid = (r.x0 + r.x1) / 2
            fit = [(abs(mid - g["mid"]), i) for i, g in enumerate(groups) if g["column"] == r.column and r.y0 - g["low"] <= gap and abs(mid - g["mid"]) <= reach]
            if fit:
                i = min(fit)[1]
                g = groups[i]
                g["n"] += 1
                g["mid"] += (mid - g["mid"]) / g["n"]
                g["low"] = max(g["low"], r.y1)
            else:
                i = len(groups)
                groups.append({"column": r.column, "low": r.y1, "mid": mid, "n": 1})
            out.append((r.id, getattr(r, page), i))
        return pd.DataFrame(out, columns=["id", page, "grp"])

    return fragments.groupBy(page).applyInPandas(one, f"id long, {page} long, grp int")


def row_clusters(fragments: DataFrame, page: str, reach: float = 6.0) -> DataFrame:
    """Rows by vertical centre: a new row begins beyond ``reach`` of the mean
    centre of the row so far."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_m=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["_m", "x0", "id"])
        row, total, n, rows = -1, 0.0, 0, []
        for m in pdf["_m"]:
            if n == 0 or abs(m - total / n) > reach:
                row, total, n = row + 1, 0.0, 0
            total, n = total + m, n + 1
            rows.append(row)
        return pd.DataFrame({"id": pdf["id"], page: pdf[page], "row": rows})

    return fragments.groupBy(page).applyInPandas(one, f"id long, {page} long, row int")
