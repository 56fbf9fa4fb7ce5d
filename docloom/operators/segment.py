"""Word segmentation of scripts written without spaces.

A clause becomes a lattice: every stretch of it that the lexicon knows is an arc,
and every single sign is one, so a path always exists.  The best path is that of
most probable words (a word's cost is minus the logarithm of its share of all
uses), found by dynamic programming from the clause's end; of equal paths the one
whose first word is longest wins.  Costs are whole millionths, so that sums and
ties do not depend on an engine's rounding.

Arcs are looked up in the lexicon, or come from a join with it where it is large, so
it may be of any size; distinct clauses are cut once.  Words come from the
corpus (:func:`mined`), from texts that have spaces (:func:`counted`), from a list
of one's own, or from all of them (:func:`merged`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import written

#: Longest word of a lexicon, in signs.
LONGEST = 12
#: Words of a lexicon that is sent to the tasks whole.
HELD = 1_000_000
#: Signs of runs whose stretches are counted together.
SIGNS = 1 << 20
#: Cost of an arc that is not there.
NONE = 1 << 60
#: A mined word has at least this many uses and is at least so many times as
#: frequent as its parts would meet by chance.
FEWEST, COHESION = 3, 8.0
RUN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]+"
PIECE = f"({RUN}|[\\p{{L}}\\p{{N}}&&[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]]+)"


def counted(words: DataFrame, col: str = "word") -> DataFrame:
    """``(word, uses)`` of a column of words of at most ``LONGEST`` signs."""
    return words.where(F.length(col).between(1, LONGEST)).groupBy(F.col(col).alias("word")).agg(F.count(F.lit(1)).alias("uses"))


def merged(*lexicons: DataFrame) -> DataFrame:
    """One lexicon of several; uses of the same word add up."""
    rows = lexicons[0].select("word", "uses")
    for x in lexicons[1:]:
        rows = rows.unionByName(x.select("word", "uses"))
    return rows.where(F.length("word").between(1, LONGEST) & (F.col("uses") > 0)).groupBy("word").agg(F.sum("uses").alias("uses"))


def stretches(clauses: DataFrame, clause: str, longest: int) -> DataFrame:
    """``(<clause>, at, size, word)``: all stretches of up to ``longest`` signs."""
    n = F.length(clause)
    at = clauses.where(n > 0).select(clause, F.explode(F.sequence(F.lit(1), n)).alias("at"))
    sized = at.select(clause, "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(clause) - F.col("at") + 1))).alias("size"))
    return sized.select(clause, "at", "size", F.substring(clause, F.col("at"), F.col("size")).alias("word"))


def _grams(longest: int):
    """Rows ``run, times, end``: the stretches of up to ``longest`` signs of some runs
    at a time, each with its uses and the least and greatest sign (or end) before and
    after it.  Equal stretches of a size get one number, from which the next size is
    numbered, so only numbers are sorted."""

    def counted(b: pa.RecordBatch):
        runs, times, marks = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
        text = "".join(runs)
        codes = _codes(text)
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        last = np.cumsum(lengths)
        own = np.repeat(np.arange(len(runs)), lengths)
        stop, begin, end = last[own], (last - lengths)[own], marks[own]
        kinds, sign = np.unique(codes, return_inverse=True)
        at, number = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        before = np.where(at > begin, np.append(-1, codes[:-1]), end)
        for size in range(1, longest + 1):
            at = at[at + size <= stop[at]]
            if not len(at):
                return
            key = number[at] * len(kinds) + sign[at + size - 1]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            number[at] = np.cumsum(new) - 1
            after = np.where(at + size < stop[at], codes[np.minimum(at + size, len(codes) - 1)], end[at])
            words = [text[i : i + size] for i in at[first].tolist()]
            sides = [f.reduceat(x, first) for x in (before[at], after) for f in (np.minimum, np.maximum)]
            cols = [pa.array(words, pa.string()), pa.array(np.full(len(first), size, np.int32)), pa.array(np.add.reduceat(times[own[at]], first)), *map(pa.array, sides)]
            yield pa.RecordBatch.from_arrays(cols, ["word", "size", "uses", "l0", "l1", "r0", "r1"])
            at = np.sort(at)

    def run(batches):
        for b in batches:
            for s, e in _together(b.column(0), SIGNS):
                yield from counted(b.slice(s, e - s))

    return run


def mined(texts: DataFrame, col: str = "text", run: str = RUN, longest: int = 4, fewest: int = FEWEST, cohesion: float = COHESION) -> DataFrame:
    """``(word, uses)`` found in runs of unspaced script: single signs, and
    stretches that are frequent, hold together (whatever way they are split, they
    are ``cohesion`` times as frequent as their parts would meet by chance) and
    stand free (two signs or more, or an end, on both sides)."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(f"({run})"), F.lit(1))).alias("run"))
    runs = runs.groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    ends = runs.select("run", "times", F.xxhash64("run").bitwiseOR(F.lit(-1 << 63)).alias("end"))  # below all signs
    found = ends.mapInArrow(_grams(longest), "word string, size int, uses long, l0 long, l1 long, r0 long, r1 long")
    known = found.groupBy("word", "size").agg(F.sum("uses").alias("uses"), ((F.min("l0") != F.max("l1")) & (F.min("r0") != F.max("r1"))).alias("free"))
    known = written(known, "grams")
    signs = known.where("size = 1").agg(F.sum("uses").alias("total"))  # one row
    long = known.where(f"size > 1 and uses >= {fewest} and free")
    cuts = long.select("word", "uses", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), "size")
    cuts = cuts.select("word", "uses", F.substring("word", F.lit(1), F.col("cut")).alias("a"), F.substring("word", F.col("cut") + 1, F.col("size")).alias("b"))
    part = known.select(F.col("word").alias("part"), F.col("uses").alias("n"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "a", "n": "na"}), "a").join(part.withColumnsRenamed({"part": "b", "n": "nb"}), "b")
    held = cuts.groupBy("word", "uses").agg(F.max(F.col("na").cast("double") * F.col("nb")).alias("chance")).crossJoin(F.broadcast(signs))
    held = held.where(F.col("uses") * F.col("total").cast("double") >= cohesion * F.col("chance")).select("word", "uses")
    return known.where("size = 1").select("word", "uses").unionByName(held)


def costs(lexicon: DataFrame) -> DataFrame:
    """``(word, cost, unknown)``; ``unknown`` is the cost of a sign that is no word."""
    total = lexicon.agg(F.sum("uses").alias("total"))  # one row
    micro = lambda x: F.round(1e6 * x).cast("long")
    return lexicon.crossJoin(F.broadcast(total)).select("word", micro(F.log(F.col("total").cast("double")) - F.log(F.col("uses").cast("double"))).alias("cost"), micro(F.log(F.col("total") * 2.0)).alias("unknown"))


def best_path(clause: str, arcs: list[list[tuple[int, int]]], unknown: int) -> list[str]:
    """The words of the best path; ``arcs[i]`` are the (size, cost) of the words that
    begin at sign i."""
    n = len(clause)
    best, size = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        options = [(best[i + s] + c, -s) for s, c in arcs[i]]
        if not any(s == -1 for _, s in options):
            options.append((best[i + 1] + unknown, -1))
        best[i], least = min(options)
        size[i] = -least
    at, out = 0, []
    while at < n:
        out.append(clause[at : at + size[at]])
        at += size[at]
    return out


def _cut(clauses, paths):
    return pa.RecordBatch.from_arrays([clauses, pa.array(paths, pa.list_(pa.string()))], ["clause", "words"])


def _joined(batches):
    """Clauses with their arcs."""
    for b in batches:
        paths = []
        for clause, arcs, unknown in zip(*(b.column(i).to_pylist() for i in range(3))):
            at: list[list[tuple[int, int]]] = [[] for _ in clause]
            for a in arcs:
                at[a["at"] - 1].append((a["size"], a["cost"]))
            paths.append(best_path(clause, at, unknown))
        yield _cut(b.column(0), paths)


class Lattice:
    """A lexicon as a tree of prefixes in arrays: ``signs`` are its letters, a node and
    a letter lead to a node by a table of open addresses (keys are exact), ``cost`` is
    that of the word that ends at a node, or -1."""

    def __init__(self, words: list[str], costs: np.ndarray, longest: int):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        words, costs = [w for w, n in zip(words, lengths) if 0 < n <= longest], costs[(lengths > 0) & (lengths <= longest)]
        lengths = lengths[(lengths > 0) & (lengths <= longest)]
        begin = np.cumsum(lengths) - lengths
        self.signs, letter = np.unique(_codes("".join(words)), return_inverse=True)
        node, keys, self.cost = np.zeros(len(words), np.int64), [], [np.full(1, -1, np.int64)]
        at, known = np.arange(len(words)), 1
        for size in range(1, longest + 1):
            at = at[lengths[at] >= size]
            key, number = np.unique(node[at] * (len(self.signs) + 1) + letter[begin[at] + size - 1], return_inverse=True)
            node[at] = known + number
            cost = np.full(len(key), -1, np.int64)
            ends = at[lengths[at] == size]
            cost[node[ends] - known] = costs[ends]
            keys.append(key)
            self.cost.append(cost)
            known += len(key)
        keys, self.cost = np.concatenate(keys), np.concatenate(self.cost)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] < 0]
            self.key[slot[free]] = keys[free]
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.next[slot] = np.arange(1, len(keys) + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next nodes, or -1."""
        key = node * (len(self.signs) + 1) + letter
        slot, out, live = self._slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(live):
            found = self.key[slot[live]]
            hit = found == key[live]
            out[live[hit]] = self.next[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
        return out

    def paths(self, clauses: list[str], unknown: int, longest: int) -> pa.ListArray:
        """The best paths of :func:`best_path`, of all clauses side by side."""
        text = "".join(clauses)
        codes = _codes(text)
        lengths = np.fromiter(map(len, clauses), np.int64, len(clauses))
        stops = np.cumsum(lengths)
        stop = np.repeat(stops, lengths)
        if len(self.signs):
            letter = np.minimum(np.searchsorted(self.signs, codes), len(self.signs) - 1)
            letter = np.where(self.signs[letter] == codes, letter, len(self.signs))
        else:
            letter = np.zeros(len(codes), np.int64)
        arcs = np.full((longest, len(codes)), NONE)  # longest words first, so they win ties
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for size in range(1, longest + 1):
            fits = at + size <= stop[at]
            at, node = at[fits], node[fits]
            node = self.step(node, letter[at + size - 1])
            at, node = at[node >= 0], node[node >= 0]
            cost = self.cost[node]
            arcs[longest - size, at] = np.where(cost >= 0, cost, NONE)
        arcs[longest - 1] = np.where(arcs[longest - 1] == NONE, unknown, arcs[longest - 1])
        place = np.arange(len(clauses))  # every clause has one place more than signs, for its end
        best, size = np.zeros(len(codes) + len(clauses) + longest, np.int64), np.ones(len(codes), np.int64)
        order = np.argsort(-lengths, kind="stable")
        many = len(clauses) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0) + 1), "left")
        sizes = np.arange(longest, 0, -1)[:, None]
        for back in range(1, lengths.max(initial=0) + 1):
            own = order[: many[back]]
            i = stops[own] - back
            ways = arcs[:, i] + best[i + place[own] + sizes]
            least = np.argmin(ways, axis=0)
            best[i + place[own]] = ways[least, np.arange(len(own))]
            size[i] = longest - least
        begins = np.zeros(len(codes) + 1, bool)
        begins[-1] = True
        at, ends = (stops - lengths)[lengths > 0], stops[lengths > 0]
        while len(at):
            begins[at] = True
            at = at + size[at]
            at, ends = at[at < ends], ends[at < ends]
        wide = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
        offsets = wide[begins].astype(np.int32)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(text.encode()))
        upto = np.append(0, np.cumsum(begins[:-1]))
        return pa.ListArray.from_arrays(pa.array(upto[np.append(0, stops)].astype(np.int32)), words)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _together(column, signs: int):
    """(from, to) of rows of about so many signs."""
    held = np.cumsum(pc.utf8_length(column).to_numpy()) // signs
    cuts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(column)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if e > s]


def _looked_up(known, unknown: int, longest: int):
    """Clauses alone; the words are at hand."""

    def run(batches):
        for b in batches:
            for s, e in _together(b.column(0), SIGNS >> 3):
                part = b.column(0).slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part, known.value.paths(part.to_pylist(), unknown, longest)], ["clause", "words"])

    return run


def cut(clauses: DataFrame, lexicon: DataFrame, col: str = "clause", longest: int = LONGEST) -> DataFrame:
    """``(clause, words)`` for each distinct clause of ``clauses``.  A lexicon of at
    most ``HELD`` words goes to the tasks whole; with a larger one the lattices' arcs
    come from a join of the clauses' stretches with it."""
    schema = "clause string, words array<string>"
    spark, priced = clauses.sparkSession, costs(lexicon)
    distinct = clauses.select(F.col(col).alias("clause")).where(F.length("clause") > 0).distinct()
    size = priced.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("unknown"), F.lit(0)).alias("unknown")).first()
    if size.n <= HELD:
        words = priced.select("word", "cost").toArrow()  # at most HELD rows
        known = spark.sparkContext.broadcast(Lattice(words["word"].to_pylist(), words["cost"].to_numpy(), longest))
        spread = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clause")  # short rows, long work: not to be coalesced
        return spread.mapInArrow(_looked_up(known, size.unknown, longest), schema)
    arcs = stretches(distinct, "clause", longest).join(priced.select("word", "cost"), "word")
    found = arcs.groupBy("clause").agg(F.collect_list(F.struct("at", "size", "cost")).alias("arcs"))
    none = F.array().cast("array<struct<at:int,size:int,cost:bigint>>")
    rows = distinct.join(found, "clause", "left").select("clause", F.coalesce("arcs", none).alias("arcs"), F.lit(size.unknown).alias("unknown"))
    return rows.mapInArrow(_joined, schema)


def pieces(text: Column) -> Column:
    """Lower-cased runs in order: of unspaced script, or of other letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(1))


def terms(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, words)`` in text order: runs of unspaced script are cut, other runs
    stay whole, so texts without such script have the terms of ``text.tokens``.
    Ids are to be unique; null ids, null texts and texts without words have no terms."""
    runs = docs.where(F.col(id_col).isNotNull()).select(id_col, F.posexplode(pieces(F.col(text_col))).alias("_n", "clause"))
    unspaced = F.col("clause").rlike(T.CJK)
    whole = runs.where(~unspaced).select(id_col, "_n", F.array("clause").alias("words"))
    parts = runs.where(unspaced)
    parts = parts.join(cut(parts, lexicon), "clause").select(id_col, "_n", "words")
    both = whole.unionByName(parts).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_n", "words"))).alias("_w"))
    return both.select(id_col, F.flatten(F.transform("_w", lambda x: x["words"])).alias("words"))
