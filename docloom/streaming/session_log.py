"""Whole chat sessions as list state: every message of a session, of any length.

A message is appended to its session's list, so state is written at its end only; what
a session is about beside its messages (when it began and was last used, how many
messages it has) is a value of its own.  Sessions are listed and read from the state
itself, by the state data source, without a second store.

Events are ``(session_id, seq, kind, role, text, at)``: ``append`` adds a message,
``delete`` forgets the session (a later message starts it anew).  Within a batch a
session's events are taken by ``seq``.  Events of null session or another kind and
blank messages are passed over.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "seq int, role string, text string, at timestamp"
ABOUT = "n_messages int, created_at timestamp, updated_at timestamp"
OUT = "session_id string, event string, n_messages int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionLog(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", MESSAGE)
        self.about = handle.getValueState("about", ABOUT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, made, used = self.about.get() if self.about.exists() else (0, None, None)
        fresh, before, events = [], n, []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            if e.kind == "delete":
                self.log.clear()
                events.append(("delete", n))
                n, made, fresh = 0, None, []
            elif e.kind == "append" and (e.text or "").strip():
                at = None if pd.isna(e.at) else e.at.to_pydatetime()
                fresh.append((int(e.seq), e.role, e.text, at))
                n, made, used = n + 1, made or at, at
        if fresh:
            self.log.appendList(fresh)
            self.about.update((n, made, used))
            events.append(("append", n))
        elif not n and (before or events):
            self.about.clear()
        yield pd.DataFrame([(key[0], *x) for x in events], columns=["session_id", "event", "n_messages"])

    def close(self) -> None:
        pass


def logged(events: DataFrame) -> DataFrame:
    """What became of each session that a batch touched."""
    own = events.where("session_id is not null").select(F.col("session_id").cast("string"), F.col("seq").cast("int"), "kind", "role", "text", "at")
    return own.groupBy("session_id").transformWithStateInPandas(SessionLog(), OUT, "update", "none")


@contextlib.contextmanager
def list_states(spark: SparkSession):
    """Queries started inside keep their state in the provider that knows lists."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(events: DataFrame, checkpoint: str) -> None:
    """Take in what is there, then stop; a later run goes on from the checkpoint."""
    with list_states(events.sparkSession):
        q = logged(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, number: df.write.format("noop").mode("overwrite").save()).start()
        q.awaitTermination()


def messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(session_id, seq, role, text, at)`` of all sessions, from the state."""
    s = spark.read.format("statestore").option("stateVarName", "log").load(checkpoint)
    return s.select(F.col("key.session_id").alias("session_id"), "list_element.*")


def sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(session_id, n_messages, created_at, updated_at)`` of all sessions."""
    s = spark.read.format("statestore").option("stateVarName", "about").load(checkpoint)
    return s.select(F.col("key.session_id").alias("session_id"), "value.*")
