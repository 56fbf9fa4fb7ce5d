"""The facade end to end on a few files."""

import json

import pytest

from docloom import models as M
from docloom.api import Engine, Settings


def test_engine(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/robot_en.md").write_text("intro line\n# Robot\n## Cleaning\nClean the brush with water. ![b](x/drill0_1.png)\n## Charging\nPut the robot on the dock to charge.\n")
    (tmp_path / "m/oven_en.txt").write_text("# Oven\nSet the heat of the oven with the knob.")
    faq = [{"idx": i, "question": q, "answer": a} for i, (q, a) in enumerate([("how do I return an item", "Within seven days."), ("where is my invoice", "In the account page.")])]
    (tmp_path / "faq.json").write_text(json.dumps(faq))
    (tmp_path / "q.csv").write_text('id,question\n100,"how do I clean the brush\nput the robot on the dock"\n101,where is my invoice refund\n100,again\n')
    e = Engine(spark, str(tmp_path / "store"), embedding=M.HashEmbedding(2048), writer=M.CannedModel((("brush", "Use **water** [PIC]"),), "Unknown."))
    chunks = {r.section_path: r for r in e.ingest_manuals(str(tmp_path / "m")).collect()}
    assert set(chunks) == {"未命名章节", "Robot", "Robot > Cleaning", "Robot > Charging", "Oven"}
    assert chunks["Robot > Cleaning"].image_ids == ["drill0_1"]
    e.build_index()
    e.ingest_faq(str(tmp_path / "faq.json"))
    q = spark.createDataFrame([("a", "clean brush water"), ("b", "oven heat knob")], "task_id string, query string")
    best = {}
    for r in sorted(e.search(q).collect(), key=lambda r: -r.score):
        best.setdefault(r.task_id, r.text)
    assert "brush" in best["a"] and "oven" in best["b"]
    got = {r.task_id: (r.route, r.answer) for r in e.ask_faq(spark.createDataFrame([("x", "where is my invoice"), ("y", "zzz")], "task_id string, query string")).collect()}
    assert got["x"] == ("q2q", "In the account page.") and got["y"][0] == "direct_llm"
    terms = {"manual": ["clean"], "customer": ["invoice"], "purchase": ["refund"]}
    rows = {r.question_id: r for r in e.answer_batch(str(tmp_path / "q.csv"), 100, 200, **terms).collect()}
    assert set(rows) == {100, 101} and rows[100].image_ids == ["drill0_1"] and "Use water <PIC>" in rows[100].answer and rows[100].route == "agentic_retrieval"
    assert rows[101].answer == "In the account page."
    assert e.answer_batch(str(tmp_path / "q.csv"), 100, 200, **terms).count() == 2


def test_an_engine_that_grows_is_one_built_at_once(spark, tmp_path):
    """Chinese clauses are found by one of their words; manuals come, change and go."""
    folder = tmp_path / "m"
    folder.mkdir()
    base = {
        "空调手册": "# 清洗\n先关闭电源再清洗滤网\n# 电源\n请关闭电源开关\n# 滤网\n滤网需要每月清洗",
        "烤箱手册": "# 温度\n转动旋钮设置温度\n# 旋钮\n旋钮可以取下清洗\n# 安全\n使用时请勿触摸温度高的表面",
    }
    for name, text in base.items():
        (folder / f"{name}.md").write_text(text)
    words = spark.createDataFrame([("滤网", 9), ("清洗", 9), ("电源", 9), ("旋钮", 9), ("温度", 9), ("关闭", 9), ("机器", 9)], "word string, uses long")
    grown = Engine(spark, str(tmp_path / "a"), words=words)
    grown.ingest_manuals(str(folder))
    assert not grown.fresh()
    grown.build_index()
    assert grown.fresh()
    q = spark.createDataFrame([("a", "滤网怎么办"), ("b", "旋钮"), ("c", "机器")], "task_id string, query string")
    bm = lambda e: {(r.item_id, r.id, r.score) for r in e.index.search(e._terms(q, "task_id", "query"), 10, "task_id", words_col="words").withColumnRenamed("task_id", "item_id").collect()}
    texts = {r.chunk_id: r.text for r in grown.chunks.read().collect()}
    found = [texts[i] for t, i, _ in bm(grown) if t == "a"]
    assert sorted(found) == sorted(t for t in texts.values() if "滤网" in t) and len(found) == 2
    (folder / "烤箱手册.md").write_text("# 机器\n机器已经换新旋钮")
    (folder / "新手册.md").write_text("# 电源\n机器没有电源")
    grown.update_manuals(str(folder))
    grown.remove_manuals(spark.createDataFrame([("新手册",)], "manual_id string"))
    (folder / "新手册.md").unlink()
    whole = Engine(spark, str(tmp_path / "b"), words=words)
    whole.ingest_manuals(str(folder))
    whole.build_index()
    assert {r.chunk_id for r in grown.chunks.read().collect()} == {r.chunk_id for r in whole.chunks.read().collect()} == {r.chunk_id for r in grown.vectors.read().collect()}
    assert grown.index.size() == whole.index.size() == 4 and grown.fresh()
    assert bm(grown) == bm(whole) and {t for t, _, _ in bm(grown)} == {"b", "c"}  # half of the chunks hold what a asks for
    (folder / "新手册.md").write_text("changed")
    grown.chunks.replace(grown._cut(str(folder)))
    with pytest.raises(ValueError):
        grown.search(q)


def test_reranker_analysis_and_language(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/robot_en.md").write_text("# Robot\nClean the brush.\n# Dock\nThe brush is red and long.\n# Other\nA brush for the dock.")

    def longest_first(questions, texts):
        return [float(len(t)) for t in texts]

    e = Engine(spark, str(tmp_path / "s"), Settings(rerank_top_n=2), reranker=longest_first, writer=M.CannedModel((("Needed: order number", "请等待"),), "other"),
               analyst=M.CannedModel((), '{"main_intent": "refund", "required_info": ["order number"]}'), translator=M.CannedModel((), "Please wait"))
    e.ingest_manuals(str(tmp_path / "m"))
    e.build_index()
    q = spark.createDataFrame([("a", "brush")], "task_id string, query string")
    got = sorted(((r.score, r.text) for r in e.search(q).collect()), reverse=True)
    assert len(got) == 2 and got[0][1].endswith("red and long.") and got[0][0] == len(got[0][1])
    (tmp_path / "faq.json").write_text('[{"idx": 0, "question": "how do I return an item", "answer": "Within days."}, {"idx": 1, "question": "where is my invoice", "answer": "In the account."}]')
    e.ingest_faq(str(tmp_path / "faq.json"))
    asked = spark.createDataFrame([(101, "zzz qqq www vvv")], "question_id int, question string")
    rows = e.answer(asked, manual=["clean"], customer=["zzz"], purchase=["refund"]).collect()
    assert [r.answer for r in rows] == ["Please wait"]


def test_settings():
    with pytest.raises(ValueError):
        Settings(chunk_chars=100, overlap_chars=100)
    with pytest.raises(ValueError):
        Settings(final_top_k=-1)
