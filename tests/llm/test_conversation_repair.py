"""Conversation repair against a plain search, in one segment and in many."""

import hashlib
import random
import re
import zlib

import pytest

from docloom.llm import conversation_repair as R

SPACES = " \t\n\v\f\r"


def plain_damage(rows):
    """(conv, turn, role, text) -> {conv: damaged rows in order}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            kept += [row] * (2 if k == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def plain_repair(rows):
    """Cheapest (cost, letters, roles and texts), one row after another, over all
    ways to write; insertions of at most two rows anywhere."""
    seen, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    best = {"": (0, "", ())}  # state: last initial written

    def follows(p, x):
        return x == "u" and p in ("", "s", "a") or x == "a" and p == "u" or x == "s" and p == ""

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def widened(states):
        for _ in range(3):
            for p, (c, a, w) in list(states.items()):
                for r in ("user", "assistant"):
                    if follows(p, r[0]):
                        put(states, r[0], (c + 2, a + "I", (*w, (r, ""))))
        return states

    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        after = {}
        for p, (c, a, w) in widened(best).items():
            put(after, p, (c + 3, a + "D", w))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if follows(p, role[:1]):
                    put(after, role[:1], (c + more, a + "K", (*w, (role, text))))
                for r in ("user", "assistant"):
                    if follows(p, r[0]):
                        put(after, r[0], (c + 2 + more, a + "R", (*w, (r, text))))
        best = after
    cost, letters, written = min((best_of for p, best_of in widened(best).items() if p in ("", "a")), key=lambda v: v[:2])
    return faults, cost, letters, written


def expected(rows):
    out = {}
    for conv, kept in plain_damage(rows).items():
        faults, cost, letters, written = plain_repair(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in written)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in FIELDS) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, _g string, task int")


def random_rows(seed, convs, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "half", "", " \t", "Why? ", "Ünder.\n", " ", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "uncle"]
    return [(c, rng.choice([t, t, t, None]), rng.choice([*roles, None]), rng.choice([*texts, None])) for c in range(convs) for t in range(rng.randint(1, turns))]


def test_real_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(R.repair_damaged(table)) == expected(rows)


@pytest.mark.parametrize("size", [3, 1024])
def test_random_conversations_in_any_segments(spark, monkeypatch, size):
    """Short segments and a narrow tree, so that conversations lie over many."""
    monkeypatch.setattr(R, "ROWS", size)
    monkeypatch.setattr(R, "FAN", 2 if size == 3 else 256)
    rows = random_rows(size, 60, 30) + [(None, None, None, None), (None, 3, "user", "ok."), (500, 5, "user", "Same.")] + [(501, 1, "user", "Same.")] * 40
    rows += [(600, t, ("user", "assistant")[t % 2], f"Turn {t // 3}.") for t in range(200)]
    assert got(R.repair_damaged(frame(spark, rows))) == expected(rows)


def test_empty_table_and_dropped_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(R.repair_damaged(frame(spark, [(conv, 0, "user", "Hi.")]))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(R.repair_damaged(frame(spark, [(1, 0, "user", "Hi.")]).where("false"))) == {}


def test_pieces_hold_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Are you there?"), (2, 0, "assistant", "Hello."), (2, 1, "system", "Be kind.")]
    pieces = R.repaired(frame(spark, rows)).orderBy("conv_id", "task", "no").collect()
    turns = {c: [(t.role, t.text) for p in pieces if p.conv_id == c for t in p.repaired] for c in (1, 2)}
    assert turns == {1: [("user", "Hi."), ("assistant", "Are you there?")], 2: [("user", "Hello."), ("assistant", "Be kind.")]}
    assert {c: "".join(p.audit for p in pieces if p.conv_id == c) for c in (1, 2)} == {1: "KR", 2: "RR"}


def test_letters_are_the_least_of_all_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "b", "", "C?"])) for t in range(rng.randint(0, 7))]
        seg, seen = R._Segment(), set()
        for t, role, text in rows:
            seg.add(t, role, text, 1, (role, text) not in seen)
            seen.add((role, text))
        state, letters, cost = R.walk(R.START, R.FIRST, R.LAST, seg.codes, seg.more, True)
        turns = R.edited(letters, seg.roles, seg.texts, seg.more, R.START)
        assert (cost, letters, tuple(turns)) == plain_repair(rows)[1:]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)) and state in (R.START, R.A)


def test_sql_says_the_same(sf):
    import duckdb

    from docloom.llm.queries import OP11_SQL

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = c.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert {r[0]: tuple(r[1:]) for r in c.execute(OP11_SQL).fetchall()} == expected(rows)
