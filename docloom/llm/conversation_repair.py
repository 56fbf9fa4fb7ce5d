"""Conversation structure repair by a bidirectional tight-arc DAG.

A conversation is to read ``(s?(ua)+)?`` by the initials of its roles.  Nodes are
(rows consumed, state), a state being what was written last; arcs are the edits
Delete, Insert, Keep and Rerole with their costs.  Forward and backward minimum
costs identify the arcs of cheapest repairs, and a walk over these takes the least
letter at each step.  Every letter leads from a state to one other state, so the
walk's frontier is one state, and the letters fix the repair.

No task holds a whole conversation.  Rows are sorted by range, so a long
conversation lies over many tasks, and each task cuts what it has into segments
of bounded size.  A conversation that is one segment is repaired where it lies;
others pass three sweeps over a tree of at most ``FAN`` nodes a group: segments'
cost matrices are multiplied upwards, forward and backward costs of their ends
are handed down; then each segment tells where its walk ends for each state it
may begin in, these maps are composed upwards, and the true states handed down.

Order and faults: rows go by ``turn`` (nulls first), those of one turn by role and
MD5 of the text, so equal rows are adjacent.  A row's first fault counts: blank
(nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last sign that is no white space is none of ``.!?``).

Defined cases: nulls in ``role`` and ``text`` count as one space; a null
``conv_id`` is a conversation of its own; a role that does not begin with s, u or
a (also an empty one) cannot be kept; rows of null turn take no part in gaps; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from docloom.llm import shared

START, S, U, A = range(4)
STATES = range(4)
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State behind a row of that initial, by the state before it.
_AFTER = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
_INSERTED = {START: U, S: U, A: U, U: A}
#: Rows and characters of a segment (one longer row is a segment of its own).
ROWS, CHARS = 1024, 1 << 20
#: Nodes of the tree that meet in one group.
FAN = 256
SPACES = " \t\n\v\f\r"
GONE = 0  # code of a row that must be deleted


def _code(initial: str, fault: str) -> int:
    if fault in ("blank", "duplicate"):
        return GONE
    kind = {"s": 0, "u": 1, "a": 2}.get(initial, 3)
    return 1 + 2 * kind + (fault == "truncated")


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, state behind, cost) of the edits that consume a row."""
    out = [[("D", p, DELETE)] for p in STATES]
    if code != GONE:
        more = TRUNCATED * ((code - 1) % 2)
        own = _AFTER.get("sua?"[(code - 1) // 2], {})
        for p in STATES:
            out[p] += [("K", own[p], KEEP + more)] if p in own else []
            out[p] += [("R", _INSERTED[p], REROLE + more)]
    return out


ARCS = [_arcs(c) for c in range(9)]


def forward(f: list[int], codes, more) -> list[list[int]]:
    """Least costs before each row and behind the last, from those in front of the
    first; each layer has its insertions in."""
    out = []
    for code, n in zip(codes, more):
        f = _inserted(f)
        out.append(f)
        g = [FAR] * 4
        for p in STATES:
            if f[p] < FAR:
                for _, q, c in ARCS[code][p]:
                    g[q] = min(g[q], f[p] + c)
        f = [min(FAR, x + DELETE * n) for x in g] if n else g
    return [*out, f]


def _inserted(f: list[int]) -> list[int]:
    u = min(f[U], f[START] + INSERT, f[S] + INSERT, f[A] + INSERT)
    return [f[START], f[S], u, min(f[A], u + INSERT)]


def backward(b: list[int], codes, more) -> list[list[int]]:
    """Least costs to the end, by layer; ``b`` is the last layer."""
    out = [b]
    for k in range(len(codes) - 1, -1, -1):
        x = out[-1]
        g = [min(min(FAR, x[q] + c + DELETE * more[k]) for _, q, c in ARCS[codes[k]][p]) for p in STATES]
        out.append(_to_insert(g))
    return out[::-1]


def _to_insert(b: list[int]) -> list[int]:
    u = min(b[U], b[A] + INSERT)
    return [min(b[START], u + INSERT), min(b[S], u + INSERT), u, min(b[A], u + INSERT)]


FIRST = [0, FAR, FAR, FAR]
LAST = _to_insert([0, FAR, FAR, 0])


def matrix(codes, more) -> list[int]:
    """Least cost from each state in front to each state behind, row by row."""
    return [x for p in STATES for x in forward([0 if q == p else FAR for q in STATES], codes, more)[-1]]


def through(f: list[int], m: list[int]) -> list[int]:
    return [min(FAR, min(f[p] + m[4 * p + q] for p in STATES)) for q in STATES]


def back(m: list[int], b: list[int]) -> list[int]:
    return [min(FAR, min(m[4 * p + q] + b[q] for q in STATES)) for p in STATES]


def walk(state: int, f: list[int], b: list[int], codes, more, last: bool) -> tuple[int, str, int]:
    """The state behind the last row, the least letters over tight arcs from
    ``state`` in front of the first, and the repair's cost; ``f`` are the costs in
    front, ``b`` those behind.  Insertions behind the last row are in only if it
    ends the conversation."""
    fore, aft = forward(f, codes, more), backward(b, codes, more)
    if last:
        fore[-1] = _inserted(fore[-1])
    best = min(fore[0][p] + aft[0][p] for p in STATES)
    letters, k = [], 0
    while True:
        here = fore[k][state]
        if k < len(codes):
            steps = [(x, q, c, 1) for x, q, c in ARCS[codes[k]][state]]
        elif not last or here == best:
            return state, "".join(letters), best
        else:
            steps = []
        steps.append(("I", _INSERTED[state], INSERT, 0))
        tight = [s for s in steps if here + s[2] + (DELETE * more[k] if s[3] else 0) + aft[k + s[3]][s[1]] == best]
        letter, state, _, on = min(tight)
        letters.append(letter + "D" * more[k] if on else letter)
        k += on


def edited(audit: str, roles, texts, more, state: int) -> list[tuple[str, str]]:
    """What the letters make of the rows, from ``state`` on."""
    out, k, skip = [], 0, 0
    for x in audit:
        if skip:
            skip -= 1
            continue
        if x in "IR":
            state = _INSERTED[state]
            out.append(("user" if state == U else "assistant", texts[k] if x == "R" else ""))
        elif x == "K":
            out.append((roles[k], texts[k]))
            state = _AFTER[roles[k][0]][state]
        if x != "I":
            skip = more[k]
            k += 1
    return out


_LONG, _TEXT = pa.int64(), pa.string()
_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first_turn", "last_turn", "first_initial", "last_initial"]
_COUNTED = [(c, _TEXT if "initial" in c else _LONG) for c in _COUNTS]
_PLACE = [("conv_id", _LONG), ("task", _LONG), ("no", _LONG), ("whole", pa.bool_())]
_SEGMENT = pa.schema([*_PLACE, ("codes", pa.list_(pa.int32())), ("more", pa.list_(_LONG)), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT)), *_COUNTED])
_PIECE = pa.schema([*_PLACE, ("audit", _TEXT), ("cost", _LONG), ("repaired", pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)]))), *_COUNTED])
_REPORT = pa.schema([("conv_id", _LONG), *[(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _TEXT), ("repaired_sha256", _TEXT)])


def _node(*names: str) -> pa.Schema:
    return pa.schema([("conv_id", _LONG), ("at", _LONG), *[(n, pa.list_(_LONG)) for n in names]])


class _Segment:
    """Rows of one conversation, in order, with their counts."""

    def __init__(self):
        self.codes, self.more, self.roles, self.texts, self.chars = [], [], [], [], 0
        self.counts = dict.fromkeys(_COUNTS[:6], 0) | dict.fromkeys(_COUNTS[6:])

    def add(self, turn, role: str, text: str, n: int, first: bool) -> None:
        body, c = text.rstrip(SPACES), self.counts
        fault = "blank" if not body else "duplicate" if not first else "" if body[-1] in ".!?" else "truncated"
        later = "blank" if not body else "duplicate"
        for name, k in ((fault, 1), (later, n - 1)):
            if name:
                c[name] += k
        initial = role[:1]
        if c["rows"] and c["last_initial"] + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        c["illegal"] += n - 1
        c["rows"] += n
        c["first_initial"] = initial if c["first_initial"] is None else c["first_initial"]
        c["last_initial"] = initial
        if turn is not None:
            c["turns"] += turn != c["last_turn"]
            c["first_turn"] = c["least"] = turn if c["least"] is None else c["least"]
            c["last_turn"] = c["most"] = turn
        self.codes.append(_code(initial, fault))
        self.more.append(n - 1)
        self.roles.append(role)
        self.texts.append("" if self.codes[-1] == GONE else text)
        self.chars += len(text)


def joined(a: dict, b: dict) -> dict:
    """Counts of two neighbouring stretches of one conversation."""
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    out = {c: a[c] + b[c] for c in _COUNTS[:6]}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for c, (x, y) in {"least": (a, b), "first_turn": (a, b), "first_initial": (a, b), "most": (b, a), "last_turn": (b, a), "last_initial": (b, a)}.items():
        out[c] = y[c] if x[c] is None else x[c]
    return out


def _cut(batches):
    """Segments of the sorted rows of a task.  The first and the last conversation
    of a task may go on in its neighbours, so their segments are not whole."""
    task = TaskContext.get().partitionId()
    done: list[dict] = []
    size = 0

    def close(seg, conv, no, whole):
        nonlocal size
        done.append({"conv_id": conv, "task": task, "no": no, "whole": whole, "codes": seg.codes, "more": seg.more, "roles": seg.roles, "texts": seg.texts} | seg.counts)
        size += seg.chars + 64 * len(seg.codes)

    conv, seg, no, runs, mark = None, None, 0, 0, None
    for b in batches:
        for c, turn, role, digest, is_row, text, n in zip(*(col.to_pylist() for col in b.columns)):
            if seg is None or c != conv:
                if seg is not None:
                    close(seg, conv, no, no == 0 and runs > 1)
                conv, seg, no, runs, mark = c, _Segment(), 0, runs + 1, None
            if not is_row:
                mark = (turn, role, digest)
            elif n:
                if len(seg.codes) >= ROWS or seg.chars and seg.chars + len(text) > CHARS:
                    close(seg, conv, no, False)
                    seg, no = _Segment(), no + 1
                seg.add(turn, role, text, n, mark == (turn, role, digest))
            if size > CHARS:
                yield pa.RecordBatch.from_pylist(done, _SEGMENT)
                done, size = [], 0
    if seg is not None:
        close(seg, conv, no, False)
    if done:
        yield pa.RecordBatch.from_pylist(done, _SEGMENT)


def segments(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Ordered segments of all conversations, written to the shared folder.
    ``copies`` tells how often a row stands there (once, if not given); 0 means
    that it only names its conversation."""
    n = F.lit(1) if copies is None else copies
    there = n > 0
    of = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    g = rows.select(F.col("conv_id").cast("long"), F.when(there, F.col("turn").cast("long")).alias("turn"), of("role").alias("role"), of("text").alias("text"), n.cast("long").alias("n"))
    g = g.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.unhex(F.md5("text")))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))
    marks = g.where("n > 0").groupBy("conv_id", "role", "digest").agg(earliest.alias("t"))
    marks = marks.select("conv_id", "t.turn", "role", "digest", F.lit(0).alias("is_row"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    place = ["conv_id", "turn", "role", "digest"]
    both = g.select(*place, F.lit(1).alias("is_row"), "text", "n").unionByName(marks)
    ranged = both.repartitionByRange(*place).sortWithinPartitions(*place, "is_row")
    return shared.materialize(ranged.mapInArrow(_cut, from_arrow_schema(_SEGMENT)), "repair-segments")


def _sweep(nodes: DataFrame, node: str, product, root, spread, down: str, levels: int) -> DataFrame:
    """What each node is handed from above, over a tree of groups of ``FAN``.

    ``nodes(conv_id, at, <node>)``; ``product`` joins the ordered values of a
    group, ``root`` gives what the whole conversation's value is handed, and
    ``spread`` deals what a group got over its ordered values.
    """
    up_arrow, down_arrow = _node(node), _node(node, down)
    up_schema, down_schema = from_arrow_schema(up_arrow), from_arrow_schema(down_arrow)

    def ordered(table):
        return sorted(table.to_pylist(), key=lambda r: r["at"])

    def rise(key, table):
        got = ordered(table)
        return pa.Table.from_pylist([{"conv_id": got[0]["conv_id"], "at": got[0]["at"] // FAN, node: product([r[node] for r in got])}], up_arrow)

    def fall(key, table):
        got = table.to_pylist()
        above = next(r[down] for r in got if r["_up"])
        got = sorted((r for r in got if not r["_up"]), key=lambda r: r["at"])
        shares = spread(above, [r[node] for r in got])
        return pa.Table.from_pylist([{"conv_id": r["conv_id"], "at": r["at"], node: r[node], down: s} for r, s in zip(got, shares)], down_arrow)

    def first(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([r | {down: root(r[node])} for r in b.to_pylist()], down_arrow)

    group = F.floor(F.col("at") / FAN).alias("_g")
    stack = [nodes]
    for _ in range(levels):
        stack.append(shared.materialize(stack[-1].groupBy("conv_id", group).applyInArrow(rise, up_schema), "repair-up"))
    out = stack.pop().mapInArrow(first, down_schema)
    while stack:
        below = stack.pop().select("conv_id", "at", node, F.lit(None).cast("array<long>").alias(down), F.lit(False).alias("_up"), group)
        above = out.select("conv_id", "at", F.lit(None).cast("array<long>").alias(node), down, F.lit(True).alias("_up"), F.col("at").alias("_g"))
        out = below.unionByName(above).groupBy("conv_id", "_g").applyInArrow(fall, down_schema)
    return out


def _product(ms: list) -> list:
    out = ms[0]
    for m in ms[1:]:
        out = [x for p in STATES for x in through(out[4 * p : 4 * p + 4], m)]
    return out


def _ends(above: list, ms: list) -> list:
    """Forward and backward costs at both ends of each node of a group, and
    whether the conversation ends there."""
    f, b, last = above[:4], above[4:8], above[8]
    fore, aft = [f], [b]
    for m in ms[:-1]:
        fore.append(through(fore[-1], m))
    for m in ms[:0:-1]:
        aft.append(back(m, aft[-1]))
    return [[*x, *y, last if k == len(ms) - 1 else 0] for k, (x, y) in enumerate(zip(fore, aft[::-1]))]


def _states(above: list, maps: list) -> list:
    out = [above[0]]
    for m in maps[:-1]:
        out.append(m[out[-1]])
    return [[s] for s in out]


def _compose(maps: list) -> list:
    return [_follow(p, maps) for p in STATES]


def _follow(p: int, maps: list) -> int:
    for m in maps:
        p = m[p] if p >= 0 else p
    return p


def _tree(parts: DataFrame) -> DataFrame:
    """``(conv_id, task, no, begin, audit, cost)`` for segments that are not whole."""
    top = parts.agg(F.max("task").alias("t"), F.max("no").alias("n")).first()
    if top.t is None:
        return parts.sparkSession.createDataFrame([], "conv_id long, task long, no long, begin int, audit string, cost long")
    wide, levels = top.n + 1, 0
    while (top.t + 1) * wide > FAN**levels:
        levels += 1
    at = (F.col("task") * wide + F.col("no")).alias("at")
    lean = parts.select("conv_id", at, "codes", "more")

    def costs(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "at": r["at"], "m": matrix(r["codes"], r["more"])} for r in b.to_pylist()], _node("m"))

    nodes = shared.materialize(lean.mapInArrow(costs, from_arrow_schema(_node("m"))), "repair-costs")
    ends = _sweep(nodes, "m", _product, lambda m: [*FIRST, *LAST, 1], _ends, "ends", levels)
    walked = pa.schema([*_node("maps"), ("audits", pa.list_(_TEXT)), ("cost", _LONG)])

    def walks(key, table):
        got = table.to_pylist()
        if len(got) != 2:
            raise ValueError("a segment without its costs")
        ends = next(r["ends"] for r in got if r["ends"] is not None)
        r = next(r for r in got if r["ends"] is None)
        f, b, last = ends[:4], ends[4:8], ends[8] == 1
        aft = backward(b, r["codes"], r["more"])[0]
        best = min(f[p] + aft[p] for p in STATES)
        found = [walk(p, f, b, r["codes"], r["more"], last) if f[p] + aft[p] == best else (-1, "", best) for p in STATES]
        row = {"conv_id": r["conv_id"], "at": r["at"], "maps": [x[0] for x in found], "audits": [x[1] for x in found], "cost": best if last else None}
        return pa.Table.from_pylist([row], walked)

    none = F.lit(None)
    wanted = lean.select("*", none.cast("array<long>").alias("ends")).unionByName(ends.select("conv_id", "at", none.cast("array<int>").alias("codes"), none.cast("array<long>").alias("more"), "ends"))
    walked_rows = shared.materialize(wanted.groupBy("conv_id", "at").applyInArrow(walks, from_arrow_schema(walked)), "repair-walks")
    states = _sweep(walked_rows.select("conv_id", "at", "maps"), "maps", _compose, lambda m: [START], _states, "state", levels)
    both = walked_rows.select("conv_id", "at", "audits", "cost", none.cast("int").alias("begin")).unionByName(
        states.select("conv_id", "at", none.cast("array<string>").alias("audits"), none.cast("long").alias("cost"), F.col("state")[0].cast("int").alias("begin"))
    )
    one = both.groupBy("conv_id", "at").agg(F.max("begin").alias("begin"), F.first("audits", True).alias("audits"), F.max("cost").alias("cost"))
    task, no = F.floor(F.col("at") / wide).alias("task"), (F.col("at") % wide).alias("no")
    return one.select("conv_id", task, no, "begin", F.get("audits", F.col("begin")).alias("audit"), "cost")


def _piece(r: dict, begin: int, audit: str, cost: int | None) -> dict:
    turns = edited(audit, r["roles"], r["texts"], r["more"], begin)
    return {c: r[c] for c in ("conv_id", "task", "no", "whole", *_COUNTS)} | {"audit": audit, "cost": cost, "repaired": [{"role": a, "text": t} for a, t in turns]}


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired conversations in ordered pieces (by ``task``, ``no``): ``conv_id,
    task, no, whole, audit, cost, repaired`` and the piece's counts.  ``whole``
    pieces are their conversation's only one; ``cost`` is the whole conversation's,
    and null but in the last of several pieces."""
    segs = segments(rows, copies)

    def at_once(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(s, 256).to_pylist():
                    _, audit, cost = walk(START, FIRST, LAST, r["codes"], r["more"], True)
                    out.append(_piece(r, START, audit, cost))
                yield pa.RecordBatch.from_pylist(out, _PIECE)

    def chosen(key, table):
        got = table.to_pylist()
        pick = next(r for r in got if r["begin"] is not None)
        r = next(r for r in got if r["begin"] is None)
        return pa.Table.from_pylist([_piece(r, pick["begin"], pick["audit"], pick["cost"])], _PIECE)

    whole = segs.where("whole").mapInArrow(at_once, from_arrow_schema(_PIECE))
    parts = segs.where("not whole")
    picks = _tree(parts)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in segs.schema if f.name not in ("conv_id", "task", "no")]
    no_pick = [F.lit(None).cast(t).alias(c) for c, t in (("begin", "int"), ("audit", "string"), ("cost", "long"))]
    both = parts.select("*", *no_pick).unionByName(picks.select("conv_id", "task", "no", *empty, "begin", "audit", "cost"))
    return whole.unionByName(both.groupBy("conv_id", "task", "no").applyInArrow(chosen, from_arrow_schema(_PIECE)))




def _told(batches):
    """One row per conversation from its pieces in order.  SHA-256 is a chain over
    the bytes, so a conversation's pieces pass one task, as a stream."""
    conv, counts, audit, digest, cost, some, open_ = None, None, [], None, 0, False, False

    def row():
        gaps = counts["most"] - counts["least"] + 1 - counts["turns"] if counts["turns"] else 0
        return {c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"conv_id": conv, "gaps": gaps, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for b in batches:
        out = []
        for r in b.to_pylist():
            if not open_ or r["conv_id"] != conv:
                if open_:
                    out.append(row())
                conv, counts, audit, digest, cost, some, open_ = r["conv_id"], r, [], hashlib.sha256(), 0, False, True
            else:
                counts = joined(counts, r)
            audit.append(r["audit"])
            cost += r["cost"] or 0
            for t in r["repaired"]:
                digest.update(f"{chr(10) if some else ''}{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                some = True
        if out:
            yield pa.RecordBatch.from_pylist(out, _REPORT)
    if open_:
        yield pa.RecordBatch.from_pylist([row()], _REPORT)


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, cost, letters, digest."""
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("long")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    parts = pieces.where("not whole").select("conv_id", "task", "no", "cost", "audit", "repaired", *_COUNTS)
    return whole.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "task", "no").mapInArrow(_told, from_arrow_schema(_REPORT)))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults put in by ``crc32(conv_id:turn) % 20``, and how often
    each stands there afterwards."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20)).alias("_c"))
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))
    return rows.withColumns({"text": text, "role": role}), F.when(F.col("_c") == 0, 0).when(F.col("_c") == 3, 2).otherwise(1)


def repair_damaged(rows: DataFrame) -> DataFrame:
    """The digest rows of the repair of damaged ``rows``."""
    return report(repaired(*damaged(rows)))
