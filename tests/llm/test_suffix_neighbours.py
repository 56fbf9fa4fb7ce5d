"""Why op9 compares whole runs: sorted neighbours alone lose a repeated passage."""

from docloom.llm import suffix_dedup


def _words(name, n):
    return [f"{name}{i}" for i in range(n)]


A = _words("x", 20) + _words("p", 30) + _words("y", 30)
B = _words("q", 20) + _words("p", 30) + _words("y", 30)
C = _words("x", 20) + _words("p", 30) + _words("z", 30)


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_neighbours_in_suffix_order_miss_a_passage():
    """A and C share 50 words around ``p0``.  In suffix order B lies between them
    and its left context differs, so no pair of neighbours shows the passage."""
    texts = [A, B, C]
    order = sorted(range(3), key=lambda i: (texts[i][20:], i))
    assert order == [0, 1, 2]
    found = set()
    for i, j in zip(order, order[1:]):
        n = _common(texts[i][19::-1], texts[j][19::-1]) + _common(texts[i][20:], texts[j][20:])
        if n >= suffix_dedup.PASSAGE:
            found.add((i, j))
    assert found == {(0, 1)}


def test_runs_find_it(spark):
    rows = [(i, " ".join(t)) for i, t in enumerate((A, B, C))]
    got = {(r.doc_id, r.start_word, r.end_word, r.kept) for r in suffix_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 0, 80, True), (1, 20, 80, False), (2, 0, 50, False)}
