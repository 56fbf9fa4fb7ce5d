"""The corpus pipeline: stages, their contracts, and the whole run."""

import corpus_pipeline as P

from docloom.llm import decontaminate, shared, simhash, toxicity


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = shared.materialize(stage(spark, docs, sf), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept and docs.count() == len(now)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            classes = simhash.near_duplicates(before).collect()
            assert now <= {r.component_id for r in classes}
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert now == kept - {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
        if name == "toxicity":
            scored = toxicity.score(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert now == {r.doc_id for r in scored if not r.predicted}
        kept = now
    got = P.run(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, names that clash."""
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "one"), (3, "one"), (4, " \n\t "), (5, "x" * 30_000), (6, "y " * 60_000), (7, "Zwölf Boxkämpfer jagen Viktor")]
    more = ["_kept", "_gone", "_removed", "_id", "_tkey", "root", "rep", "h"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *more) for d, t in rows], schema)
    for k, (name, stage) in enumerate(P.STAGES):
        assert stage(spark, docs.where("false"), sf).count() == 0, name
        docs = shared.materialize(stage(spark, docs, sf), name)
        if k < len(P.STAGES) - 1:
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            assert all(tuple(r)[5:] == tuple(more) for r in docs.collect())
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect())
    assert ids == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 5), (True, 6), (True, 7)]


def test_a_run_resumes_where_it_stopped(spark, sf, tmp_path, monkeypatch):
    seen = []

    def step(name, fails=False):
        def run(spark, docs, sf_dir):
            seen.append(name)
            if fails and seen.count(name) == 1:
                raise RuntimeError("driver lost")
            return docs.where("doc_id % 3 > 0")

        return name, run

    monkeypatch.setattr(P, "STAGES", [step("a"), step("b", True), step("c")])
    try:
        P.run(spark, sf, str(tmp_path))
    except RuntimeError:
        pass
    got = P.run(spark, sf, str(tmp_path))
    assert seen == ["a", "b", "b", "c"] and 0 < got.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert P.run(spark, sf, str(tmp_path)).count() == got.count() and len(seen) == 4
