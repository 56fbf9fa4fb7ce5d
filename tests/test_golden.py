"""Golden cases of the operators, and their edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions import text as T
from docloom.operators import agent, chat, chunking, evidence, faq, fusion, kg, layout, lexical, order, vector
from docloom.sources import tables
from docloom.streaming import sessions


def words(text):
    """One token per word, white space kept in front: reversible."""
    import re

    return re.findall(r"\s*\S+", text)


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def packed(spark, items, config):
    df = spark.createDataFrame(items, "document_id long, section string, order_idx long, page_idx int, text string")
    return sorted(chunking.greedy_chunks(df, config, words).collect(), key=lambda r: r.chunk_index)


def test_chunk_overlap(spark):
    c = chunking.Config(8, 10, 2)
    got = packed(spark, [(1, "1 INTRODUCTION", 1, 0, "alpha beta gamma delta epsilon zeta"), (1, "1 INTRODUCTION", 2, 1, "eta theta iota kappa lambda mu"), (1, "2 METHODS", 4, 2, "planner reads state and then acts")], c)
    assert [r.section for r in got] == ["1 INTRODUCTION", "1 INTRODUCTION", "2 METHODS"]
    assert all(r.token_count <= 10 for r in got)
    assert got[0].text.endswith("epsilon zeta") and got[1].text.startswith("epsilon zeta")
    assert (got[1].page_start, got[1].page_end) == (0, 1)


def test_chunk_oversize(spark):
    text = " ".join(f"token-{i}" for i in range(25))
    got = packed(spark, [(1, "", 0, 0, text)], chunking.Config(8, 10, 2))
    assert len(got) == 3 and all(r.token_count <= 10 and r.source_orders == [0] for r in got)


def test_config_refuses_overlap():
    with pytest.raises(ValueError, match="smaller than target_tokens"):
        chunking.Config(100, 200, 100)


def test_approximate_tokens_are_reversible():
    rng = random.Random(1)
    for _ in range(200):
        x = "".join(rng.choice("ab1_ \n\t.é中 ") for _ in range(rng.randint(0, 40)))
        assert "".join(chunking.approx_tokens(x)) == x


@pytest.mark.parametrize(
    "line, level",
    [("2 METHODS", 1), ("2.1 Data", 2), ("3 planner", 1), ("VLM/LLM", None), ("T = emb(s) : s in V", None), ("A LONG TITLE", 1), ("A small title", None), ("Abstract", 1), ("x " * 20, None), ("", None)],
)
def test_heading_level(spark, line, level):
    assert one(spark, T.heading_level(F.col("t")), t=line) == level


def test_section_path_does_not_pad(spark):
    rows = [(1, 0, "A", 1), (1, 1, "body", None), (1, 2, "C", 3), (1, 3, "body", None), (1, 4, "B", 2)]
    got = chunking.section_path(spark.createDataFrame(rows, "d int, o int, t string, l int"), "d", "o", "t", "l").orderBy("o").collect()
    assert [r.section_path for r in got] == [["A"], ["A"], ["A", "C"], ["A", "C"], ["A", "B"]]


def test_page_context(spark):
    rows = [(1, 0, 0, "Introduction"), (1, 1, 1, "Planner context"), (1, 2, 1, "IMAGE"), (1, 3, 1, "Executor context"), (1, 4, 2, "Conclusion"), (1, 5, 9, "Far")]
    df = spark.createDataFrame(rows, "d int, o int, p int, t string")
    got = {r.o: r.context for r in chunking.pages_around(df, "d", "p", "o", "t", 1).collect()}
    assert got[2] == "[Page 1] Introduction\nPlanner context\nExecutor context\n[Page 3] Conclusion"
    near = {r.o: r.context for r in chunking.around(df, "d", "o", "t", 1, 1).collect()}
    assert near[2] == "Planner context\nExecutor context"


def test_truncate_context(spark):
    cut = lambda t, n: one(spark, T.truncate_context(F.col("t"), n), t=t)
    assert cut("## Methods", 8) == "## Metho..." and cut("short", 8) == "short"
    assert cut("123456789. rest", 11) == "123456789." and cut("1. 4567890", 8) == "1. 45678..."


@pytest.mark.parametrize(
    "top, second, reason",
    [(0.8573, 0.7634, "threshold_pass"), (0.7764, 0.7415, "score_gap_below_threshold"), (0.8450, 0.7561, "threshold_pass"), (0.8575, 0.8450, "score_gap_below_threshold"), (0.35, 0.0, "threshold_pass"), (0.34, 0.0, "vector_score_below_threshold"), (0.0, 0.0, "no_candidates")],
)
def test_faq_reason(spark, top, second, reason):
    assert one(spark, faq.reason(F.col("a"), F.col("b")), a=top, b=second) == reason


def test_faq_cascade(spark):
    asked = spark.createDataFrame([(i,) for i in range(4)], "k long")
    q = spark.createDataFrame([(0, 10, 0.9, 1), (0, 11, 0.5, 2), (1, 12, 0.9, 1), (1, 13, 0.89, 2), (2, 14, 0.2, 1)], "k long, id long, score double, rank int")
    a = spark.createDataFrame([(0, 20, 0.9, 1), (1, 21, 0.8, 1), (1, 22, 0.4, 2), (2, 23, 0.6, 1), (2, 24, 0.6, 2)], "k long, id long, score double, rank int")
    got = {r.k: (r.route, r.faq_id, r.a_reason) for r in faq.cascade(asked, q, a, "k").collect()}
    assert got == {0: ("q2q", 10, "skipped"), 1: ("q2a", 21, "threshold_pass"), 2: ("direct_llm", None, "score_gap_below_threshold"), 3: ("direct_llm", None, "no_candidates")}


def test_turns(spark):
    got = one(spark, T.turns(F.col("t")), t='"first ""line""",\r\n\n  second, ')
    assert got == ['first "line"', "second"]
    assert one(spark, T.turns(F.col("t")), t="  ") == []
    assert one(spark, T.turns(F.col("t"), "single"), t=" a\nb, ") == ["a\nb"] and one(spark, T.turns(F.col("t"), "auto"), t="a\nb") == ["a", "b"]
    with pytest.raises(ValueError):
        T.turns(F.col("t"), "double")


def test_case_folding_is_full(spark):
    signs = [chr(c) for c in range(0x21, 0x2FFF) if not chr(c).isspace()] + ["ﬃ", "ﬆ", "ΣΑΣ ΟΔΟΣ", "Straße", "ꭰ"]
    df = spark.createDataFrame([(s,) for s in signs], "t string")
    wrong = [r.t for r in df.select("t", T.casefold_key(F.col("t")).alias("k")).collect() if r.k != r.t.casefold()]
    assert len(wrong) <= 8, wrong  # letters that the two languages' Unicode tables know differently


def test_white_space_is_that_of_unicode(spark):
    df = spark.range(0x10000).where("id not between 55296 and 57343").selectExpr("id", "concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'utf-32'), 'b ', decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')) t")
    old = T.strip(F.regexp_replace("t", r"(?U)\s+", " "))
    assert df.where(T.ws_normalize(F.col("t")) != old).count() == 0


def test_case_folding_computes_its_text_once(spark):
    df = spark.createDataFrame([("  Straße\u00a0\t ﬁn  ΟΔΟΣ ",), ("a  b\u3000c d\n",), ("\u2003",), (None,), ("ẞß ss",)], "t string")
    key = df.select(T.casefold_key(F.col("t")).alias("k"))
    assert [r.k for r in key.collect()] == ["strasse fin οδοσ", "a b c d", "", None, "ssss ss"]
    plan = key._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1  # it was there for every use of what comes of it


def test_relationships_fold_each_name_once_for_equal_rows(spark):
    rows = spark.createDataFrame([("A", "b", "x", "", 1.0, 3), ("A", "b", "x", "", 5.0, 2), ("B", "a", "x", "k", 2.0, 1), ("a", "B", "y", "k", 1.0, 9)], "src string, tgt string, description string, keyword string, weight double, seq long")
    out = kg.merge_relationships(rows)
    assert [tuple(r) for r in out.collect()] == [("a", "b", "B", "a", 5.0, "x y", "k")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # equal rows meet below the folding


def test_packing_cuts_every_text_once():
    seen = []
    tokens = lambda t: seen.append(t) or chunking.approx_tokens(t)
    units = [(f"unit {k} " + "word " * 40, k, 0) for k in range(60)]
    got = [[u[0] for u in held] for held in chunking.pack(units, chunking.Config(60, 80, 10), tokens)]
    assert got == [[u[0] for u in held] for held in chunking.pack(units, chunking.Config(60, 80, 10), chunking.approx_tokens, True)] and len(got) == 60
    assert len(seen) == len(set(seen))


def test_horizontal_blocks(spark):
    lines = F.from_json("t", "array<struct<dx:double,dy:double>>")
    told = lambda *v: one(spark, layout.horizontal(lines), t=json.dumps([{"dx": a, "dy": b} for a, b in v]))
    assert told() and told((1, 0)) and told((-1, 0), (0, 1)) and not told((0, 1)) and not told((0, 1), (0, -1), (0.7, 0.7))


def test_numbers_within_a_hot_key(spark):
    rows = [("hot", k) for k in range(300)] + [("x", 5), (None, 1), (None, 2)]
    got = order.numbered(spark.createDataFrame(rows, "k string, v int").repartition(7), "k", "v", "n").collect()
    assert sorted((r.k or "", r.v, r.n) for r in got) == sorted([("hot", k, k) for k in range(300)] + [("x", 5, 0), ("", 1, 0), ("", 2, 1)])


def test_rules(spark):
    rule = lambda t, i: one(spark, chat.rule_customer_service(F.col("t"), F.col("i")), t=t, i=i)
    assert rule("怎么安装", "63") and not rule("怎么安装", "64") and rule("我要退货", "x")
    assert not rule("如何退货", "x") and rule("如何退货，收到了", "x") and not rule("how to fly", "")
    got = one(spark, chat.clauses(F.col("t")), t="发票怎么开？另外如何清洁滤网，also clean the filter.")
    assert got == ["发票怎么开？", "如何清洁滤网？", "clean the filter?"]


def test_graph_expansion(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "a", 4)], "src string, tgt string, seq int")
    seeds = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "node string, score double")
    got = evidence.expand(seeds, edges, depth=2).groupBy("node").agg(F.max("score").alias("s"))
    assert {r.node: round(r.s, 4) for r in got.collect()} == {"a": 0.8, "b": 0.8, "c": 0.512}
    few = spark.createDataFrame([("h", f"n{i}", i) for i in range(30)], "src string, tgt string, seq int")
    hub = spark.createDataFrame([("h", 1.0)], "node string, score double")
    assert {r.node for r in evidence.expand(hub, few).collect()} == {f"n{i}" for i in range(20)}
    assert evidence.expand(hub, few.where("false")).count() == 0


def test_merge_does_not_depend_on_row_order(spark):
    rows = [("x", 0.5, "b", 2, "second"), ("x", 0.9, "a", 3, "third"), ("x", 0.7, "b", 1, "first"), ("y", 0.1, "c", 4, "only")]
    out = []
    for r in (rows, rows[::-1]):
        m = evidence.merge(spark.createDataFrame(r, "id string, score double, channel string, seq int, record string"), ["id"], first=["record"])
        out.append(sorted(map(tuple, m.collect())))
    assert out[0] == out[1] and out[0][0] == ("x", 0.9, ["a", "b"], 1, "first")


def test_rrf_is_symmetric(spark):
    rows = [("q", 1, "vector", 0, 1, 0.9), ("q", 2, "vector", 0, 2, 0.8), ("q", 2, "bm25", 1, 1, 3.0)]
    got = {r.id: (round(r.score, 9), r.sources) for r in fusion.rrf(spark.createDataFrame(rows, "k string, id int, source string, list_no int, rank int, score double"), "k").collect()}
    assert got == {1: (round(1 / 61, 9), "vector:0.9000"), 2: (round(1 / 62 + 1 / 61, 9), "vector:0.8000;bm25:3.0000")}


def test_bm25_small(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue bird sings")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "fox"), (8, "nothing here")], "item_id long, text string")
    got = lexical.top_k(lexical.scores(docs, q), "item_id", 5).collect()
    assert [(r.item_id, r.doc_id, r.rank) for r in got] == [(7, 1, 1)]


def test_vector_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = lambda: sorted((r.query_id, r["rank"], r.id) for r in vector.top_k(df.where("vec_id % 9 = 0 and embedding is not null"), df, 4).collect())
    first = got()
    monkeypatch.setattr(vector, "HELD", 32)
    monkeypatch.setattr(vector, "CORPUS", 20)
    assert got() == first and len(first) == 40 and all(i == q for q, r, i in first if r == 1)


def test_kg_rules(spark):
    good = {"entities": [{"name": "Planner", "type": "Module", "description": "plans"}, {"name": "RAG Store", "type": "Store", "description": "keeps"}], "relationships": [{"source": "planner", "target": "rag  store", "keywords": "reads, writes", "weight": 8}]}
    k = M.knowledge_of("```json\n" + json.dumps(good) + "\n```")
    assert k["relationships"] == [{"source": "Planner", "target": "RAG Store", "description": "", "keywords": ["reads", "writes"], "weight": 8.0}]

    class Second:
        calls = 0

        def complete(self, prompts):
            self.calls += 1
            return ['{"entities": [], "relationships": [{"source": "a", "target": "b"}]}' if self.calls == 1 else json.dumps(good)]

    model = Second()
    assert len(M.extract_knowledge("p", model)["relationships"]) == 1 and model.calls == 2
    with pytest.raises(ValueError):
        M.extract_knowledge("p", M.CannedModel((), "no json"))


def test_model_replies():
    assert M.route_of('x {"intent": "manual", "confidence": 7} y') == {"intent": "manual", "confidence": 1.0, "reason": ""}
    assert M.route_of("junk") is None and M.plan_of("junk")["sufficient"] and not M.plan_of('{"queries": ["a", "a", "b"]}')["sufficient"]
    assert M.plan_of('{"queries": ["a", "a", "b", "c", "d"]}')["queries"] == ["a", "b", "c"]
    assert M.selection_of('{"selected_chunk_ids": ["b", "z", "b"]}', ["a", "b"], 5) == {"ids": ["b"], "fallback": False}
    assert M.selection_of("?", ["a", "b", "c"], 2) == {"ids": ["a", "b"], "fallback": True}
    assert M.rewrites_of('["x"]', ["a", "b"]) == ["a", "b"] and M.rewrites_of('```json\n["x", "y"]\n```', ["a", "b"]) == ["x", "y"]
    assert M.first_object('<think>{"a": 0}</think> {bad} {"a": 1} tail') == {"a": 1}
    registry = M.ProcessorRegistry()
    registry.register("image", len)
    assert registry.get("image") is len
    with pytest.raises(KeyError):
        registry.get("table")


def test_picture_tokens():
    text, ids = M.picture_tokens("A [PIC] b drill0_1oven_2 Manual3_4x <PIC:vr_7> [fax_3] own_9.", ["own_9", "img_1"])
    assert text == "A <PIC> b <PIC><PIC> Manual3_4x <PIC> <PIC> own_9." and ids == ["own_9", "vr_7", "fax_3", "drill0_1", "oven_2"]
    assert M.picture_tokens("see img_1, ximg_1", ["img_1"]) == ("see <PIC>, ximg_1", ["img_1"])
    assert M.picture_tokens("none <PIC>", []) == ("none ", [])


def test_reading_order_of_two_columns(spark):
    rows = [(1, 0, "t", 50.0, 10.0, 550.0, 30.0), (2, 0, "t", 50.0, 50.0, 280.0, 90.0), (3, 0, "t", 320.0, 50.0, 550.0, 95.0), (4, 0, "t", 50.0, 100.0, 280.0, 150.0), (5, 0, "t", 320.0, 100.0, 550.0, 160.0)]
    df = spark.createDataFrame(rows, "id long, page long, kind string, x0 double, y0 double, x1 double, y1 double")
    got = layout.reading_order(df, "page", 300.0).orderBy("pos").collect()
    assert [r.id for r in got] == [1, 2, 4, 3, 5]


def test_caption_below_image(spark):
    cols = "id long, page long, kind string, x0 double, y0 double, x1 double, y1 double"
    items = spark.createDataFrame([(1, 0, "image", 72.0, 100.0, 180.0, 208.0), (2, 0, "table", 72.0, 300.0, 180.0, 320.0)], cols)
    caps = spark.createDataFrame([(9, 0, "text", 72.0, 225.0, 300.0, 240.0)], cols)
    got = {r.id: (r.caption_id, r.gap) for r in layout.nearest_caption(items, caps, "page").collect()}
    assert got == {1: (9, 17.0), 2: (9, 60.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/a.md").write_text("# A\ntext")
    (tmp_path / "m/sub/b.txt").write_text("plain")
    (tmp_path / "m/c.bin").write_text("no")
    assert {(r.manual_id, r.text) for r in tables.read_manuals(spark, str(tmp_path / "m")).collect()} == {("a", "# A\ntext"), ("b", "plain")}
    (tmp_path / "q.csv").write_text('id,question\n1012,"one\ntwo"\nx,"a ""b"""\n')
    assert [tuple(r) for r in tables.read_questions(spark, str(tmp_path / "q.csv")).collect()] == [(1012, "one\ntwo"), (-1, 'a "b"')]
    df = spark.createDataFrame([(1, "é", 1), (2, "b", 2)], "id long, t string, v long")
    tables.write_jsonl(df, str(tmp_path / "j"))
    back = tables.read_jsonl(spark, str(tmp_path / "j"), "id long, t string, v long")
    assert sorted(map(tuple, back.collect())) == [(1, "é", 1), (2, "b", 2)]
    new = spark.createDataFrame([(2, "c", 3)], df.schema)
    once = tables.upsert(df, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, ["id"]).collect())) == [(1, "é", 1), (2, "c", 3)]
    ok, bad = tables.checked_chunks(spark.createDataFrame([("x",), ("  ",), (None,), ("y" * 9000,)], "text string"))
    assert ok.count() == 1 and bad.count() == 3
    assert tables.same_manifest(df.where("id = 1"), df.where("id = 1"), ["t", "v"]).first().fresh
    (tmp_path / "f.json").write_text('[{"idx": 0, "question": "q", "answer": "a"}, {"idx": 1, "question": " q ", "answer": "b"}]')
    assert [tuple(r) for r in tables.read_faq(spark, str(tmp_path / "f.json")).collect()] == [(0, "q", "a")]
    (tmp_path / "g.json").write_text('[{"idx": 0, "question": "q", "answer": "a"}, {"idx": 2, "question": " ", "answer": "c"}]')
    with pytest.raises(Exception, match="FAQ entry without question: 2"):
        tables.read_faq(spark, str(tmp_path / "g.json")).collect()
    pages = tables.read_pages(spark, str(tmp_path / "m/c.bin"), lambda p, b: [(0, 0, "text", b.decode())])
    assert [r.text for r in pages.collect()] == ["no"]


def test_history_suffix():
    rows = [("user", "1"), ("assistant", "2"), ("user", "3"), ("system", "4"), ("user", "5")]
    assert sessions.suffix(rows, 2) == rows[2:] and sessions.suffix(rows, 9) == rows and sessions.suffix(rows, 0) == []


def test_clusters_match_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(i, i // 30, rng.uniform(0, 500), y := rng.uniform(0, 200), 0.0, y + rng.uniform(4, 20)) for i in range(90)]
    got = {r.id: r.row for r in agent.row_clusters(spark.createDataFrame(rows, "id long, page long, x0 double, y0 double, x1 double, y1 double"), "page").collect()}
    for page in range(3):
        held, row = [], -1
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: ((r[3] + r[5]) / 2, r[2])):
            mid = (r[3] + r[5]) / 2
            if not held or abs(mid - sum(held) / len(held)) > 6:
                held, row = [], row + 1
            held.append(mid)
            assert got[r[0]] == row


def test_entity_merge_caps_text(spark):
    rows = [("Straße", "x", "d" * 1500, 1), (" STRASSE ", "y", "e" * 800, 2), ("strasse", "y", "e" * 800, 3)]
    got = kg.merge_entities(spark.createDataFrame(rows, "name string, type string, description string, seq int")).collect()
    assert len(got) == 1 and got[0].name == "Straße" and len(got[0].description) == 2000 and got[0].description.endswith("...") and got[0].mentions == 3
