"""Text statistics against plain counting, and learned decision lists."""

import re
import zlib
from collections import Counter

import numpy as np

from docloom.llm import quality_rules as Q

ODD = [None, "", " \n\t ", "one", "a b a b a b a", "x\x1fy z w", "a b c\na b c\n \n \na b c", "#*$%&|<>!", "é " * 3000, "w" * 50_000, "\n".join(["same line here"] * 500), "Zwölf 12 Boxkämpfer. \U0001f600 jagen"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_counts_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = ODD + [r.text for r in docs.collect()]
    assert [Q.statistics(t)[:5] for t in texts] == [plain(t) for t in texts]


def test_window_keys_stay_exact_for_many_words():
    ids = np.array([5, 6, 7, 8, 5, 6, 7, 9])
    assert Q._repeated(ids, 10) == Q._repeated(ids, 1 << 40) == 6


def test_query_on_real_and_odd_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.train(docs, labels)
    odd = spark.createDataFrame([(None if i == 3 else i, t, 1, "k") for i, t in enumerate(ODD + ODD[:2])], "doc_id long, text string, n_words int, kept string")
    got = Q.judge(odd, rules).collect()
    assert len(got) == len(ODD) + 2 and all(not r.kept or not r.base_failed for r in got) and None not in {r.kept for r in got}
    assert Q.judge(odd.where("false"), rules).collect() == []
    for r in Q.judge(docs, rules).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and bool(rules.keeps(np.array([[r[c] for c in Q.STATS]]))[0]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.score(docs, labels).join(labels, "doc_id").select("doc_id", "base_failed", "kept", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not r.base_failed]
    assert np.mean([r.kept == (r.quality == 1) for r in held]) > 0.98


def rows_of(**columns):
    n = len(next(iter(columns.values())))
    return np.array([[int(columns.get(c, [100] * n)[i]) for c in Q.STATS] for i in range(n)], np.int64)


def test_learns_conjunctions_in_order_and_prunes_noise():
    rng = np.random.default_rng(5)
    n = 3000
    symbols, stops = rng.integers(0, 100, n), rng.integers(0, 100, n)
    keep = ~((symbols >= 50) & (stops < 30))
    stats = rows_of(n_symbols=symbols, n_stop=stops, n_digits=rng.integers(0, 100, n))
    rules = Q.learn(stats, keep, np.arange(n) % 3 == 0)
    assert (rules.keeps(stats) == keep).mean() > 0.99 and len(rules.rules) <= 6
    noisy = keep ^ (rng.random(n) < 0.03)
    rules = Q.learn(stats, noisy, np.arange(n) % 3 == 0)
    assert (rules.keeps(stats) == keep).mean() > 0.95 and len(rules.rules) <= Q.MOST_RULES
    assert "if" in str(rules) and str(rules).splitlines()[-1] in ("keep", "drop")


def test_no_labels_keep_all(spark):
    rules = Q.learn(np.zeros((0, len(Q.STATS)), np.int64), np.zeros(0, bool), np.zeros(0, bool))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert rules.rules == () and [r.kept for r in Q.judge(docs, rules).collect()] == [True]
