"""Segmentation, JSON objects in replies, regions, modal analysis, session logs."""

import itertools
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions import text as T
from docloom.operators import layout, modal, segment
from docloom.sources.collection import Collection
from docloom.streaming import session_log


def best_cut(clause, lexicon):
    """All ways to cut a clause, by cost, then longest words first."""
    import math

    total = sum(lexicon.values())
    cost = lambda w: round(1e6 * (math.log(total) - math.log(lexicon[w]))) if w in lexicon else round(1e6 * math.log(2.0 * total))
    ways = []
    for cuts in itertools.product([0, 1], repeat=len(clause) - 1):
        words, now = [], clause[0]
        for c, x in zip(cuts, clause[1:]):
            words, now = (words + [now], x) if c else (words, now + x)
        words.append(now)
        if all(len(w) == 1 or w in lexicon for w in words):
            ways.append((sum(map(cost, words)), [-len(w) for w in words], words))
    return min(ways)[2]


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_paths_are_the_best_of_all_cuts(spark, monkeypatch, held):
    monkeypatch.setattr(segment, "HELD", held)
    rng = random.Random(2)
    lexicon = {w: rng.randint(1, 40) for w in ["滤", "滤网", "网", "清洗", "洗滤", "每月", "月清", "月清洗", "需要", "要每"]}
    clauses = ["".join(rng.choices("滤网清洗每月需要x", k=rng.randint(1, 9))) for _ in range(80)] + ["滤网需要每月清洗"]
    got = segment.cut(spark.createDataFrame([(c,) for c in clauses + ["", None]], "clause string"), spark.createDataFrame(list(lexicon.items()), "word string, uses long")).collect()
    assert {r.clause for r in got} == set(clauses)
    for r in got:
        assert r.words == best_cut(r.clause, lexicon)


def test_terms_of_mixed_texts_and_mined_words(spark):
    docs = spark.createDataFrame([(1, "The 滤网 needs清洗, OK"), (2, None), (3, "plain WORDS 7"), (4, "")], "id long, text string")
    lexicon = spark.createDataFrame([("滤网", 5), ("清洗", 5)], "word string, uses long")
    got = {r.id: r.words for r in segment.terms(docs, lexicon, "id").collect()}
    assert got == {1: ["the", "滤网", "needs", "清洗", "ok"], 3: ["plain", "words", "7"]}
    assert segment.terms(docs.where("false"), lexicon, "id").count() == 0
    rng = random.Random(1)
    words = ["冰箱", "温度", "开关", "滤网"]
    texts = ["".join(rng.choice(words) if rng.random() < 0.6 else rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(12)) for _ in range(60)]
    mined = {r.word for r in segment.mined(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert set(words) <= mined and len([w for w in mined if len(w) > 1 and w not in words]) <= 6


def test_paths_side_by_side_are_those_of_single_clauses():
    rng = random.Random(5)
    signs = "abß滤😀"
    for longest in (1, 4, 12):
        lexicon = {"".join(rng.choices(signs, k=rng.randint(1, 6))): rng.choice([1, 5, 5, 7, 40]) for _ in range(60)} | {"": 1, "滤" * 13: 1}
        lattice = segment.Lattice(list(lexicon), segment.np.array(list(lexicon.values())), longest)
        clauses = ["".join(rng.choices(signs + "x", k=rng.randint(1, 25))) for _ in range(200)] + ["a" * 300, "z"]
        arcs = lambda c: [[(s, lexicon[c[i : i + s]]) for s in range(1, min(longest, len(c) - i) + 1) if c[i : i + s] in lexicon] for i in range(len(c))]
        assert lattice.paths(clauses, 9, longest).to_pylist() == [segment.best_path(c, arcs(c), 9) for c in clauses]
    assert segment.Lattice([], segment.np.zeros(0, "int64"), 3).paths(["ab"], 9, 3).to_pylist() == [["a", "b"]]


def test_mining_counts_every_stretch_once_and_makes_no_row_of_each(spark, monkeypatch):
    monkeypatch.setattr(segment, "SIGNS", 16)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcß😀", k=rng.randint(0, 30))) for _ in range(60)] * 3 + ["a" * 400, None, ""]
    rows = [r for b in [list(segment._grams(4)(iter([_batch([t for t in texts if t])])))] for x in b for r in x.to_pylist()]
    runs = [t for t in texts if t]
    for size in range(1, 5):
        uses, sides = {}, {}
        for k, t in enumerate(runs):
            for i in range(len(t) - size + 1):
                w = t[i : i + size]
                uses[w] = uses.get(w, 0) + 2
                sides.setdefault(w, (set(), set()))
                sides[w][0].add(ord(t[i - 1]) if i else -1 - k)
                sides[w][1].add(ord(t[i + size]) if i + size < len(t) else -1 - k)
        got = {}
        for r in rows:
            if r["size"] == size:
                have = got.setdefault(r["word"], [0, set(), set()])
                have[0] += r["uses"]
                have[1] |= {r["l0"], r["l1"]}
                have[2] |= {r["r0"], r["r1"]}
        assert {w: h[0] for w, h in got.items()} == uses
        assert all((min(h[1]), max(h[1]), min(h[2]), max(h[2])) == tuple(f(x) for x in sides[w] for f in (min, max)) for w, h in got.items())
    assert len(rows) < sum(4 * len(t) for t in runs)
    assert segment.mined(spark.createDataFrame([(t,) for t in texts], "text string"), run="[abcß😀]+").where("word = 'aa'").count() <= 1


def _batch(runs):
    return pa.RecordBatch.from_arrays([pa.array(runs), pa.array([2] * len(runs)), pa.array([-1 - k for k in range(len(runs))])], ["run", "times", "end"])


def test_first_object_is_that_of_a_decoder(spark):
    rng = random.Random(3)
    good = ['{"a": 1}', '{"a": {"b": "}"}}', '{"q": "say \\"{\\" now"}', "{}", '{"p": "c:\\\\\\\\"}', '{"n": null, "l": [{"x": 2}]}']
    texts = [None, "", "{", "no"] + [rng.choice(["", " ", "\n", "{", "{bad} ", "x"]).join(rng.choices([*good, "{bad}", "'{'", '"', "}", "```json", "<think>{}</think>"], k=rng.randint(1, 5))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.first_object(F.col("t")).alias("o")).collect():
        assert (json.loads(r.o) if r.o is not None else None) == M.first_object(texts[r.i]), texts[r.i]


def test_regions_of_a_long_chain_and_loners(spark):
    chain = [(i, 0, 10.0 * i, 0.0, 10.0 * i + 8, 5.0) for i in range(200)]
    alone = [(500, 0, 0.0, 50.0, 5.0, 55.0), (501, 1, 0.0, 0.0, 8.0, 5.0)]
    df = spark.createDataFrame(random.Random(1).sample(chain + alone, 202), "id long, page long, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.region for r in layout.regions(df, "page", 3.0, 3.0).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 501}
    assert layout.regions(df.where("false"), "page", 3.0, 3.0).count() == 0


class Shaky:
    """Fails on its first calls for some prompts; counts what it was asked."""

    def __init__(self, path):
        self.path = path

    def complete(self, prompts):
        with open(self.path, "a") as f:
            f.writelines(p.split("Content: ")[1].split("\n")[0] + "\n" for p in prompts)
        asked = open(self.path).read().split("\n")
        if "shaky" in prompts[0] and asked.count("shaky") < 2 or "dead" in prompts[0]:
            raise RuntimeError("busy")
        return ['{"detailed_description": "D", "entity_info": {"entity_name": "N", "summary": "S"}}']


def test_requests_are_asked_once_and_again_only_where_they_failed(spark, tmp_path):
    rows = [("d", "1", "table", "same"), ("d", "2", "table", "same"), ("d", "3", "table", "shaky"), ("d", "4", "equation", "dead"), ("e", "5", "image", "x y")]
    items = spark.createDataFrame([(*r, ["c"], None) for r in rows], "document_id string, item_id string, kind string, text string, captions array<string>, context string")
    store, model = Collection(spark, str(tmp_path / "r"), "request_id"), Shaky(str(tmp_path / "asked"))
    requests = modal.prepared(items)
    models = {"table": model, "equation": model}
    replies = modal.asked(requests, models, store)
    count = lambda x: open(tmp_path / "asked").read().split("\n").count(x)
    assert (count("same"), count("shaky"), count("dead")) == (1, 2, 2)
    assert {(r.error, r.attempts) for r in replies.where("reply is null").collect()} == {("busy", 2), ("no model for image", 2)}
    modal.asked(requests, models, store, rounds=1)
    assert (count("same"), count("shaky"), count("dead")) == (1, 2, 3)
    got = {r.item_id: r for r in modal.analysed(requests, replies).collect()}
    assert {i: r.parsed for i, r in got.items()} == {"1": True, "2": True, "3": True, "4": False, "5": False}
    assert got["4"].description == "dead" and got["5"].summary == "x y" and got["1"].chunk_text.startswith("Table\n")
    chunks, entities, edges = modal.graph(modal.analysed(requests, replies))
    assert chunks.count() == 5 and {r.name for r in entities.where("type = 'document'").collect()} == {"DOCUMENT::d", "DOCUMENT::e"}
    assert {(r.src, r.tgt, r.weight, len(r.sources)) for r in edges.collect() if r.src == "N (table)"} == {("N (table)", "DOCUMENT::d", 10.0, 3)}
    with pytest.raises(Exception, match="two analyses of"):
        modal.analysed(requests.unionByName(requests), replies).collect()
    with pytest.raises(Exception, match="no processor"):
        modal.prepared(items.withColumn("kind", F.lit("sound"))).collect()


def test_sessions_grow_over_runs_and_are_read_from_state(spark, tmp_path):
    schema = "session_id string, seq int, kind string, role string, text string, at timestamp"
    folder = tmp_path / "in"

    def put(name, rows):
        df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("at", F.timestamp_seconds("seq"))
        df.coalesce(1).write.parquet(str(folder / name))

    def run():
        session_log.run(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder)), str(tmp_path / "state"))
        logs = {}
        for r in sorted(session_log.messages(spark, str(tmp_path / "state")).collect()):
            logs.setdefault(r.session_id, []).append(r.text)
        return logs, {r.session_id: r.n_messages for r in session_log.sessions(spark, str(tmp_path / "state")).collect()}

    put("1", [("a", k, "append", "user", f"m{k}") for k in range(30)] + [("b", 0, "append", "user", "x"), (None, 1, "append", "user", "lost"), ("c", 1, "append", "user", "  ")])
    logs, about = run()
    assert logs == {"a": [f"m{k}" for k in range(30)], "b": ["x"]} and about == {"a": 30, "b": 1}
    put("2", [("a", 30, "append", "assistant", "m30"), ("b", 1, "delete", None, None), ("d", 5, "append", "user", "old"), ("d", 6, "delete", None, None), ("d", 7, "append", "user", "new")])
    logs, about = run()
    assert logs == {"a": [f"m{k}" for k in range(31)], "d": ["new"]} and about == {"a": 31, "d": 1}
