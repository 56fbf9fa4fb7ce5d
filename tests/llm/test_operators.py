"""llm operators against brute force, round trips and held-out accuracy, and on
nulls, empty tables, repeated rows, ties and extra columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from docloom.llm import bpe_tree, decontaminate, embed_dedup, html_extract, mil_quality, queries, shared, simhash, suffix_dedup, token_files, toxicity, url_filter

ODD_DOCS = [(None, "no id"), (1, None), (2, ""), (3, "one"), (4, " \n\t "), (5, "x" * 30_000), (6, "w " * 5000), (3, "one"), (7, "Zwölf Boxkämpfer jagen Viktor"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", "s", 1, "k", 9) for d, t in ODD_DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _kept string, root int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.root].add(r.node)
    assert sorted(map(len, by.values())) == [1, 50, 301]


def test_html(spark, sf):
    page = """<html><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies on this site and that is all.</div><article><header><h1>Title &amp; more</h1></header>
    <p>The   first&nbsp;part of the<br>story <b>was told<p>Next.</p><div class="comments"><p>I think that this is a great story.</p></div></article><aside>The news of the day</aside>"""
    assert html_extract.extract(page) == "Title & more\n\nThe first part of the story was told\n\nNext."
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("<p>cut off <b") == "cut off"
    out = html_extract.main_text(spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (None, None, None, None)], "page_id long, url string, html string, text int")).collect()
    assert len(out) == 3 and out[2].text == "" and out[0].n_chars == len(out[0].text)
    assert queries.op1_html_extraction(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_simhash_matches_brute_force(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = []
    for i in ids:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i]).encode().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) * 2 > len(grams) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if bits[b]))
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = roots(len(ids), links)
    assert all(got[d].fingerprint == f"{f:016x}" and got[d].component_id == ids[c] for d, f, c in zip(ids, fps, comp))


def test_simhash_counters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    for _ in range(3):
        b[100:] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    true = np.bitwise_count(a[:, None] ^ b[None]) <= 3
    got = np.zeros_like(true)
    for i, j in simhash.near(a, b):
        got[i, j] = True
    assert (got == true).all() and (simhash.near_small(a, b) == true.diagonal()).all()


def test_simhash_tiles_lose_nothing(spark, monkeypatch):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, base.replace(f"word{7 * i % 400} ", f"other{i} ", 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(simhash, "CHUNK", 8)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == whole


def test_simhash_odd_cases(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD_DOCS)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 4)} == {1}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7]


def test_urls(spark, sf):
    assert url_filter.split_url("https://A.b.COM:80/x?y#z") == ("a.b.com:80", "/x")
    assert url_filter.split_url("http://h#f") == ("h", "") and url_filter.split_url("nothing") == url_filter.split_url(None) == ("", "")
    rows = [(1, "http://example.com/en/1"), (2, "http://www.example.com/en/"), (3, "http://notexample.com/en/"), (4, "http://a.net/es/x"), (5, None), (5, None), (6, "http://x.com"), (7, "://com/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("com/", "allow"), 4: ("net/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/", "allow")}
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), []).collect()} == {"allow"}


def test_url_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.sql(queries.OP3_SQL).fetchall(), key=lambda r: r[0])
    assert sorted(map(tuple, queries.op3_url_filter(spark, sf).collect()), key=lambda r: r[0]) == want


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    rules = [(f"h{i}.com", "/", "block" if i % 2 else "allow") for i in range(50)]
    url_filter.write_index(str(tmp_path / "x/rules.idx"), rules)
    index = url_filter.Index(str(tmp_path / "x/rules.idx"))
    hits = index.probe([b"h7.com\0/", b"h8.com\0/", b"h99.com\0/"])
    assert list(index.block[hits[:2]]) == [1, 0] and hits[2] == -1


def test_token_files(docs, texts, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    at = 0
    got = sorted(token_files.round_trip(docs, path, 1).collect(), key=lambda r: r.doc_id)
    for r, i in zip(got, sorted(texts), strict=True):
        ids = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = sorted(token_files.round_trip(odd, path, 1).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD_DOCS) and [r.doc_id is None for r in rows[:2]] == [True, True]
    assert [r.start for r in rows[1:]] == list(np.cumsum([r.n_tokens for r in rows])[:-1])
    assert token_files.round_trip(empty, path, 1).count() == 0


def test_token_encoder_on_strange_texts():
    import pyarrow as pa

    e = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    xs = ["can't it's 3.14 ...", "ΑΣ ΑΣ. İstanbul ß ẞ", "<|endoftext|> a", "a\x1cb\x85c d　e", "dogs' 's '", "x.,", "  a  "] + [f"A{chr(c)}b {chr(c)}X.{chr(c)}" for c in range(1, 0x400)]
    for x, got in zip(xs, e.many(pa.array(xs))):
        assert np.frombuffer(got, e.kind).tolist() == e.lib.encode(x, add_special_tokens=False).ids, ascii(x)


def test_bpe_equals_tiktoken(docs, texts, odd, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    for r in bpe_tree.digests(docs, path, public_tokenizers.PATTERN).collect():
        assert r.ids_sha256 == digest(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    tree = bpe_tree.Tree.load(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice(["ab", "thein", "éèüß日本語", "   \n\t", "====--", "0123456789", "aaaaab"])
        x = "".join(rng.choice(letters) for _ in range(rng.randint(1, 1500)))
        assert np.frombuffer(tree.encode(x), "<u4").tolist() == lib.encode_ordinary(x)
    assert bpe_tree.digests(odd, path, public_tokenizers.PATTERN).count() == len(ODD_DOCS)
    assert bpe_tree.token_ids(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (mil_quality, "quality")])
def test_classifiers_on_held_out_rows(spark, module, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= module.AT) for r in got)
    assert sum(r.predicted == r[label] for r in got) / len(got) > 0.93


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (mil_quality, "quality")])
def test_classifiers_on_odd_cases(spark, odd, empty, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = module.score(odd, none).collect()
    assert len(got) == len(ODD_DOCS) and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    assert module.score(odd, some).count() == len(ODD_DOCS)
    assert module.score(empty, some).count() == 0
    assert toxicity.keep_clean(odd, none.withColumnRenamed(label, "toxic")).columns == odd.columns


def test_decontamination_matches_brute_force(spark, docs, texts, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    for r in bench.collect():
        s = set(decontaminate._shingles(decontaminate.clean_words(r.text)))
        for i, t in texts.items():
            if len(s & set(decontaminate._shingles(decontaminate.clean_words(t)))) >= 0.8 * len(s):
                want.add((i, r.item_id))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == set(texts) - {i for i, _ in want}
    items = spark.createDataFrame([(1, "Viktor"), (2, None), (3, ""), (None, "x"), (4, "one")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()} == {(7, 1), (3, 4)}
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_decontamination_finds_a_long_item_across_passages(spark):
    rng = random.Random(5)
    item = " ".join(f"t{rng.randint(0, 400)}" for _ in range(70))
    doc = " ".join(["filler"] * 101) + " " + item + " " + " ".join(["end"] * 55)
    ix = decontaminate.Index([(9, item), (8, "short other item of words")]).prepare()
    assert [h[0] for h in ix.search(doc)] == [9] and not ix.search(" ".join(item.split()[:40]))


def test_suffix_spans_match_brute_force(docs, texts):
    words = {i: shared.words_of(t) for i, t in texts.items()}
    n = suffix_dedup.PASSAGE
    first, count = {}, collections.Counter()
    for i in sorted(words):
        for p in range(len(words[i]) - n + 1):
            k = tuple(words[i][p : p + n])
            count[k] += 1
            first.setdefault(k, (i, p))
    want = set()
    for i, w in words.items():
        for kept in (True, False):
            hits = [(p, 1) for p in range(len(w) - n + 1) if count[k := tuple(w[p : p + n])] > 1 and (first[k] == (i, p)) is kept]
            want |= {(i, s, e, kept) for s, e in suffix_dedup.merge(hits)}
    got = {(r.doc_id, r.start_word, r.end_word, r.kept) for r in suffix_dedup.spans(docs).collect()}
    assert got == want and want


def test_suffix_removal(spark, odd, empty):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(60))
    own = [" ".join(f"d{i}x{rng.randint(0, 9999)}" for _ in range(30)) for i in range(4)]
    rows = [(1, f"{own[0]}\n{passage} {own[1]}", 1), (2, f"{passage}  {own[2]}", 1), (3, passage, 1), (3, passage, 1), (4, own[3], 1), (None, passage, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, rows[0][1], 1), (2, own[2], len(own[2])), (4, own[3], 1), (None, passage, 1)], key=str)
    same = suffix_dedup.remove_repeats(odd)
    assert same.columns == odd.columns and suffix_dedup.spans(empty).count() == 0
    assert {r.doc_id for r in same.collect()} == {d for d, _ in ODD_DOCS}
    again = [(1, "a b " * 80), (2, "c")]
    assert suffix_dedup.spans(spark.createDataFrame(again, "doc_id long, text string")).where("not kept").count() == 1


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = np.concatenate([centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 32)) * rng.uniform(0.05, 0.4, (400, 1)), centres[:3], centres[:3]])
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v.astype(np.float32))]
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0), (904, [1.0], 0), (905, [], 0), (906, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = roots(len(u), list(zip(*np.nonzero(near))))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    links = sum(got[i].n_links for i in range(len(u)))
    assert links >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(u)))
    assert sum(got[i].component_id == comp[i] for i in range(len(u))) >= 0.95 * len(u)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 905))
    assert got[906].component_id == 904 and got[906].n_links == 1 and not got[906].kept
    whole = {i: (r.n_links, r.component_id) for i, r in got.items()}
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()} == whole
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0
