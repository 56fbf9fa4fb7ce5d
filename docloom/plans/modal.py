"""Registered query on the analysis of images, tables and equations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from docloom.operators import modal
from docloom.plans.registry import register
from docloom.session import scratch, table, written
from docloom.sources.collection import Collection

QUERIES: dict[str, tuple] = {}
query = register(QUERIES)


class Stub:
    """Replies that follow from the prompt: an object, prose, or an error."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            mark = hashlib.md5(p.encode()).hexdigest()
            if "click" in p:
                out.append("Sure {x} " + json.dumps({"detailed_description": f"About {mark}", "entity_info": {"entity_name": f"E{mark[:6]}", "summary": f"S {mark[:3]}"}}))
            elif "view" in p:
                out.append(f"<think>so</think> It shows {mark}")
            else:
                raise RuntimeError("no answer")
        return out


@query(r"""WITH i AS (SELECT user_id::VARCHAR AS document_id, event_id::VARCHAR AS item_id, ['image', 'table', 'equation'][event_id % 3 + 1] AS kind, event_type || ' ' || props AS text FROM events),
p AS (SELECT *, ['Describe the image.', 'Describe what the table says.', 'Explain the equation.'][item_id::BIGINT % 3 + 1] || chr(10) || 'Captions: Figure ' || (item_id::BIGINT % 9) || chr(10) || 'Content: ' || text || chr(10) || 'Context: ' || chr(10) || 'Reply with a JSON object: {"detailed_description": ..., "entity_info": {"entity_name": ..., "summary": ...}}' AS prompt FROM i),
a AS (SELECT *, md5(prompt) AS m, text LIKE '%click%' AS parsed, text LIKE '%view%' AS told FROM p),
d AS (SELECT *, CASE WHEN parsed THEN 'About ' || m WHEN told THEN 'It shows ' || m ELSE text END AS description FROM a),
e AS (SELECT *, CASE WHEN parsed THEN 'E' || m[1:6] ELSE kind || '-' || sha256(item_id)[1:24] END AS entity_name, CASE WHEN parsed THEN 'S ' || m[1:3] ELSE description END AS summary,
  upper(kind[1]) || kind[2:] || chr(10) || 'Captions: Figure ' || (item_id::BIGINT % 9) || chr(10) || 'Content: ' || text || chr(10) || 'Analysis: ' || description AS chunk_text FROM d)
SELECT document_id, item_id, kind, md5(description) AS description, entity_name, summary, parsed, md5(chunk_text) AS chunk_text, entity_name || ' (' || kind || ')|DOCUMENT::' || document_id AS edge FROM e""")
def modal_analysis(spark, d):
    """Requests of all items, asked once by content, answered, parsed or fallen back,
    with the edge of each entity to its document's hub."""
    i = F.col("event_id")
    items = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("document_id"), i.cast("string").alias("item_id"), F.element_at(F.array(F.lit("image"), F.lit("table"), F.lit("equation")), (i % 3 + 1).cast("int")).alias("kind"),
        F.concat_ws(" ", "event_type", "props").alias("text"), F.array(F.concat(F.lit("Figure "), i % 9)).alias("captions"), F.lit(None).cast("string").alias("context"),
    )
    with scratch(spark, "modal") as root:
        requests = modal.prepared(items)
        replies = written(modal.asked(requests, {k: Stub() for k in modal.PROCESSORS}, Collection(spark, f"{root}/replies", "request_id")), "replies")
    got = modal.analysed(requests, replies)
    edges = modal.graph(got)[2].select("document_id", F.col("src"), F.concat_ws("|", "src", "tgt").alias("edge"))
    x = got.select("document_id", "item_id", "kind", F.md5("description").alias("description"), "entity_name", "summary", "parsed", F.md5("chunk_text").alias("chunk_text"))
    x = x.withColumn("src", F.concat("entity_name", F.lit(" ("), "kind", F.lit(")"))).join(edges, ["document_id", "src"])
    return x.drop("src").select("document_id", "item_id", "kind", "description", "entity_name", "summary", "parsed", "chunk_text", "edge")
