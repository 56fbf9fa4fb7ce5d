"""Registered streaming query: the conversations table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import models as M
from docloom.plans.registry import register
from docloom.session import checkpoint, scratch, shared_root, table
from docloom.streaming import session_log, sessions

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)

REWRITER = M.CannedModel((), '{"query": "standalone"}')
ANSWERER = M.CannedModel((("standalone", "A follow-up."),), "A first answer.")


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seen FROM conversations),
h AS (SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS history FROM s WHERE seen < 6 OR (seen = 6 AND role = 'user') GROUP BY conv_id)
SELECT conv_id AS session_id, count(*)::INT AS n_messages, count(*) FILTER (role = 'user')::INT AS n_user, max(turn)::INT AS last_seq, any_value(h.history) AS history FROM conversations JOIN h USING (conv_id) GROUP BY conv_id""")
def stream_sessions(spark, d):
    root = shared_root(spark) + f"/sessions-{uuid.uuid4().hex}"
    m = _stream(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("seq"), "role", "text")
    sessions.run_to_table(sessions.sessions(m), f"{root}/out", f"{root}/state")
    out = spark.read.parquet(f"{root}/out")
    w = Window.partitionBy("session_id").orderBy(F.desc("batch"))
    last = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return last.select("session_id", "n_messages", "n_user", "last_seq", F.md5(F.array_join("history", "\n")).alias("history"))


@query(r"""WITH u AS (SELECT conv_id, turn, turn % 4 = 2 AS has_images, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = 'user'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(turn) OVER (PARTITION BY conv_id) AS first FROM u WHERE t <> '')
SELECT conv_id::VARCHAR AS session_id, turn::INT AS seq, md5(t) AS message, md5(CASE WHEN rn = 1 OR has_images THEN t ELSE 'standalone' END) AS rewritten,
CASE WHEN rn = 1 OR has_images THEN 'A first answer.' ELSE 'A follow-up.' END AS answer, (2 * rn)::INT AS n_messages, first AS created, turn AS updated FROM n""")
def stream_chat_turns(spark, d):
    """Every user turn as a chat message: rewritten with what was said before,
    answered, remembered; some come with images, which skip the rewrite."""
    root = shared_root(spark) + f"/turns-{uuid.uuid4().hex}"
    e = _stream(spark, d).where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.lit("message").alias("kind"), "text", (F.col("turn") % 4 == 2).alias("has_images"), F.timestamp_seconds("turn").alias("at")
    )
    sessions.run_to_table(sessions.chat_turns(e, REWRITER, ANSWERER), f"{root}/out", f"{root}/state", output="append")
    out = spark.read.parquet(f"{root}/out")
    return out.select("session_id", "seq", F.md5("message").alias("message"), F.md5("rewritten").alias("rewritten"), "answer", "n_messages", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))


def _stream(spark, d):
    path = f"{d}/conversations.parquet"
    schema = table(spark, d, "conversations").schema
    glob = path.rsplit("/", 1)
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return files.parquet(path) if _is_dir(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", glob[1]).parquet(glob[0])


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(r"""WITH e AS (SELECT conv_id, turn, role, text, role = 'user' AND turn > 0 AND length(text) < 120 AS gone FROM conversations),
k AS (SELECT e.*, max(CASE WHEN gone THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM e)
SELECT conv_id::VARCHAR AS session_id, count(*)::INT AS n_messages, min(turn) AS created, max(turn) AS updated, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS log
FROM k WHERE NOT gone AND trim(text) <> '' AND (cut IS NULL OR turn > cut) GROUP BY conv_id""")
def stream_session_log(spark, d):
    """Whole sessions kept as list state and read back from it; a short question past
    the first turn deletes what was said before."""
    gone = (F.col("role") == "user") & (F.col("turn") > 0) & (F.length("text") < 120)
    e = _stream(spark, d).select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.when(gone, "delete").otherwise("append").alias("kind"), "role", "text", F.timestamp_seconds("turn").alias("at")
    )
    with scratch(spark, "session-log") as root:
        session_log.run(e, f"{root}/state")
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "role", "text").alias("t")))), lambda x: x["t"]), "\n")
        log = session_log.messages(spark, f"{root}/state").groupBy("session_id").agg(F.md5(told).alias("log"))
        about = session_log.sessions(spark, f"{root}/state").select("session_id", "n_messages", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))
        return checkpoint(about.join(log, "session_id"))
