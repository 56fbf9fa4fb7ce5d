"""Parsers, stores and chat turns that no SQL states."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom import models as M
from docloom.operators import images
from docloom.sources import stores
from docloom.streaming import sessions


def test_customer_analysis():
    got = M.analysis_of('ok {"main_intent": " refund ", "sub_questions": ["a", " ", "a", 3], "risk_notes": "x"}', "q")
    assert got == {"main_intent": "refund", "sub_questions": ["a", "3"], "required_info": [], "risk_notes": []}
    assert M.analysis_of("no json", "q")["risk_notes"] == ["analysis_json_parse_failed"]
    assert M.analysis_of(None, "q")["sub_questions"] == ["q"]


def test_analyzed_and_language(spark):
    df = spark.createDataFrame([(1, "Where is my order and its invoice?", "在路上"), (2, "发票呢", "在路上"), (3, None, None)], "id int, question string, answer string")
    model = M.CannedModel((("invoice", '{"main_intent": "order", "sub_questions": ["order", "invoice"]}'),), "?")
    rows = {r.id: r.a for r in M.analyzed(df, "question", "a", model).collect()}
    assert rows[1].sub_questions == ["order", "invoice"] and rows[2].main_intent == "发票呢" and rows[3].main_intent == ""
    turned = M.in_question_language(df, "question", "answer", M.CannedModel((), " **On its way** "))
    assert {r.id: r.answer for r in turned.collect()} == {1: "On its way", 2: "在路上", 3: None}


def test_current_turn():
    assert M.current_turn_of('{"query": " how long does the invoice take "}', "how long") == "how long does the invoice take"
    assert M.current_turn_of("none", " how long ") == "how long"
    assert M.turn_prompt([], "x") is None and M.turn_prompt([("user", " ")], "x") is None
    assert "assistant: yes" in M.turn_prompt([("assistant", "yes")], "x")


def test_chat_completions():
    seen = []

    def send(url, headers, body):
        seen.append((url, body))
        return {"choices": [{"message": {"content": "hi"}}]}

    m = M.ChatCompletions("k", "m", "http://h/v1/", json_mode=True, thinking=False, send=send)
    assert m.complete(["a", "b"]) == ["hi", "hi"]
    assert seen[0][0] == "http://h/v1/chat/completions" and seen[1][1]["messages"][1]["content"] == "b"
    assert seen[0][1]["response_format"] == {"type": "json_object"} and seen[0][1]["thinking"] == {"type": "disabled"}
    assert m.body("a", ["data:x"])["messages"][1]["content"][1]["image_url"] == {"url": "data:x"}
    assert M.ChatCompletions.from_env("X", {}, required=False) is None
    with pytest.raises(ValueError):
        M.ChatCompletions.from_env("X", {})
    assert M.ChatCompletions.from_env("X", {"X_API_KEY": "k", "X_MODEL": "m", "X_MAX_TOKENS": "7"}).max_tokens == 7


def test_embedding_settings():
    ok = {"EMBEDDING_PROVIDER": "local", "EMBEDDING_MODEL_PATH": "p"}
    assert M.EmbeddingSettings.from_env(ok, 64).dim == 64
    for wrong in ({"EMBEDDING_DIM": "65"}, {"EMBEDDING_DIM": "x"}, {"EMBEDDING_DIM": "-1"}, {"EMBEDDING_DEVICE": "tpu"}, {"EMBEDDING_PROVIDER": "other"}, {"EMBEDDING_BATCH_SIZE": "0"}):
        with pytest.raises(ValueError):
            M.EmbeddingSettings.from_env(ok | wrong, 64)
    with pytest.raises(ValueError):
        M.EmbeddingSettings.from_env({"EMBEDDING_MODEL": "m"})


def test_bad_base64(spark):
    df = spark.createDataFrame([("YWI=",), ("YWI",), ("data:image/GIF;base64,YWI=",), ("a b",), (None,)], "v string")
    got = [r.x and (r.x.mime, bytes(r.x.content), r.x.size_bytes) for r in df.select(images.decoded(F.col("v")).alias("x")).collect()]
    assert got == [("image/png", b"ab", 2), None, ("image/gif", b"ab", 2), None, None]


def test_image_line_and_question(spark):
    one = spark.range(1).select(
        images.image_line(F.lit(1), F.lit("a.png"), F.lit(3), F.lit(4), F.lit(" t "), F.lit("")).alias("line"),
        images.image_line(F.lit(2), F.lit(None), F.lit(None), F.lit(4), F.lit(None), F.lit("s")).alias("bare"),
        images.augmented(F.lit(" q "), F.lit("ocr: t")).alias("asked"), images.augmented(F.lit("q"), F.lit(" ")).alias("alone"),
    ).first()
    assert tuple(one) == ("image_1; file=a.png; size=3x4; ocr=t", "image_2; vlm=s", "q\n\nImage context:\nocr: t", "q")


def test_stores(spark, tmp_path):
    path = f"file:{tmp_path}/chunks"
    stores.save(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "document_id string, n int"), path, 1)
    stores.save(spark.createDataFrame([("a", 9)], "document_id string, n int"), path, 2)
    assert sorted(map(tuple, stores.load(spark, path).collect())) == [("a", 9), ("b", 1)]
    assert [r.n for r in stores.load(spark, path, "a").collect()] == [9]
    with pytest.raises(FileNotFoundError):
        stores.load(spark, path, "c")
    assert stores.checked(stores.load(spark, path, "b"), "b").count() == 1
    with pytest.raises(Exception, match="mismatch"):
        stores.checked(stores.load(spark, path), "b").collect()


def test_graph_store(spark, tmp_path):
    def rows(*x):
        return spark.createDataFrame(list(x), "document_id string, name string")

    root = f"file:{tmp_path}/kg"
    stores.ParquetKGStore(spark, root, 1).insert(rows(("a", "c1"), ("b", "c2")), rows(("a", "e1"), ("b", "e2")), rows(("a", "r1")))
    s = stores.ParquetKGStore(spark, root, 2)
    s.insert(rows(("a", "c3")), rows(("a", "e3")), rows(("a", "r3")))
    assert sorted(r.name for r in s.table("nodes").collect()) == ["e2", "e3"]
    assert sorted(r.name for r in s.table("chunks").collect()) == ["c2", "c3"]


def test_traces(spark, tmp_path):
    answered = spark.createDataFrame([(1, "yes"), (2, "no")], "id int, answer string")
    ev = spark.createDataFrame([(1, "c1", 0.5, "a\nb"), (1, "c2", 0.9, "x" * 200)], "id int, chunk_id string, score double, text string")
    stores.write_traces(stores.traces(answered, ev, "id"), f"file:{tmp_path}/t")
    got = {r.id: r for r in spark.read.json(f"file:{tmp_path}/t").collect()}
    assert [c.chunk_id for c in got[1].final_chunks] == ["c2", "c1"] and got[1].final_chunks[1].text_preview == "a b"
    assert got[1].final_chunks[0].text_preview == "x" * 180 + "..." and got[2].final_chunks == []


def test_refused_records(spark):
    e = spark.createDataFrame([("a", "T", "d"), (" ", "T", "d"), (None, "T", "d")], "name string, type string, description string")
    good, bad = stores.entity_records(e)
    assert [r.type for r in good.collect()] == ["t"] and bad.count() == 2


def test_ensured_sessions(spark):
    known = spark.createDataFrame([("s1",)], "session_id string")
    asked = spark.createDataFrame([(1, "s1"), (2, "gone"), (3, None)], "request_id int, session_id string")
    got = {r.request_id: r.session_id for r in sessions.ensured(asked, known).collect()}
    assert got[1] == "s1" and len({got[2], got[3]}) == 2 and "gone" not in got.values()
    assert got == {r.request_id: r.session_id for r in sessions.ensured(asked, known).collect()}


def test_turns_across_batches(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    cols = ["session_id", "seq", "kind", "text", "has_images", "at"]
    at = pd.Timestamp("2024-01-01")
    first = [("s", 0, "message", "one", False, at), ("s", 1, "message", "  ", False, at), ("s", 2, "message", "two", False, at), ("t", 0, "message", "x", True, at)]
    second = [("s", 3, "message", "three", False, at), ("t", 1, "delete", None, False, at), ("t", 2, "message", "again", False, at)]
    rewriter, answerer = M.CannedModel((("user: again", "{}"),), '{"query": "full"}'), M.CannedModel((), "A")
    for rows in (first, second):
        spark.createDataFrame(pd.DataFrame(rows, columns=cols)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).withColumn("seq", F.col("seq").cast("int"))
        sessions.run_to_table(sessions.chat_turns(stream, rewriter, answerer), out, f"{tmp_path}/state", output="append")
    got = {(r.session_id, r.seq): (r.rewritten, r.n_messages) for r in spark.read.parquet(out).collect()}
    assert got == {("s", 0): ("one", 2), ("s", 2): ("full", 4), ("t", 0): ("x", 2), ("s", 3): ("full", 6), ("t", 2): ("again", 2)}
