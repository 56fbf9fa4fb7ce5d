"""Chat sessions as a keyed stream: append messages, keep the last turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 6
OUT = "session_id long, n_messages int, n_user int, last_seq int, history array<string>"
STATE = "n_messages int, n_user int, last_seq int, history array<string>, roles array<string>"


def suffix(rows: list[tuple[str, str]], n: int = HISTORY) -> list[tuple[str, str]]:
    """(role, text) rows from the n-th last user message on; all if fewer."""
    if n <= 0:
        return []
    users = [i for i, (role, _) in enumerate(rows) if role == "user"]
    return rows[users[-n] :] if len(users) >= n else rows


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, users, last, texts, roles = state.get if state.exists else (0, 0, -1, [], [])
    rows = list(zip(roles, texts))
    new = pd.concat(list(frames)).sort_values("seq")
    for r in new.itertuples():
        rows.append((r.role, r.text))
    rows = suffix(rows)
    n, users, last = int(n + len(new)), int(users + (new["role"] == "user").sum()), int(max(last, new["seq"].max()))
    state.update((n, users, last, [t for _, t in rows], [r for r, _ in rows]))
    yield pd.DataFrame({"session_id": [key[0]], "n_messages": [n], "n_user": [users], "last_seq": [last], "history": [[t for _, t in rows]]})


def sessions(messages: DataFrame) -> DataFrame:
    """``messages(session_id, seq, role, text)`` stream -> the state of each
    session that changed.  State per session is bounded by HISTORY turns."""
    return messages.groupBy("session_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, output: str = "update") -> None:
    """Drain what is there into parquet, batch by batch (exactly once per batch
    number), then stop."""

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


TURN = "session_id string, seq int, message string, rewritten string, answer string, n_messages int, created_at timestamp, updated_at timestamp"
TURN_STATE = "n_messages int, roles array<string>, texts array<string>, created_at timestamp, updated_at timestamp"


def ensured(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``requests(request_id, session_id)`` with the session each one talks to: its
    own if that is known, else a new one.  The new id follows from the request,
    so that a repeated task gives the same."""
    ids = known.select(F.col("session_id").alias("_known")).distinct()
    new = F.md5(F.concat(F.lit("session-"), F.col("request_id").cast("string")))
    return requests.join(ids, F.col("session_id") == F.col("_known"), "left").withColumn("session_id", F.coalesce("_known", new)).drop("_known")


def chat_turns(events: DataFrame, rewriter, answerer) -> DataFrame:
    """``events(session_id, seq, kind, text, has_images, at)`` stream -> one row per
    answered message, two stored messages each.

    A ``message`` is rewritten with what was said before (as it is, if it has
    images or nothing was said), answered, and both are remembered; what a later
    rewrite sees of a user's message is its rewritten form.  A ``delete`` forgets
    the session; a later message starts it anew.  Blank messages are ignored.
    Kept per session: the last HISTORY user turns and their answers."""
    from docloom import models as M

    def run(key, frames, state):
        n, roles, texts, made, _ = state.get if state.exists else (0, [], [], None, None)
        rows, out = list(zip(roles, texts)), []
        for e in pd.concat(list(frames)).sort_values("seq").itertuples():
            if e.kind == "delete":
                n, rows, made = 0, [], None
                continue
            message = (e.text or "").strip()
            if not message:
                continue
            prompt = None if e.has_images else M.turn_prompt(rows, message)
            query = message if prompt is None else M.current_turn_of(rewriter.complete([prompt])[0], message)
            answer = answerer.complete([query])[0]
            rows = suffix([*rows, ("user", query), ("assistant", answer)])
            n, made = n + 2, made if made is not None else e.at
            out.append((key[0], e.seq, message, query, answer, n, made, e.at))
        if n:
            state.update((n, [r for r, _ in rows], [t for _, t in rows], made, out[-1][-1] if out else state.get[4]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])

    return events.groupBy("session_id").applyInPandasWithState(run, TURN, TURN_STATE, "append", GroupStateTimeout.NoTimeout)
