"""Analysis of images, tables and equations as tables of requests and replies.

Items become requests, keyed by the hash of what is asked, so equal items are asked
once.  Replies are kept on disk by that key; only requests without a good reply are
asked, failed ones again in later rounds, and every round is written before the next,
so a job that breaks off goes on where it was.  Good replies are parsed, others fall
back to what the item itself says, and the analyses become chunks, entities and edges
to the document's hub.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import models as M
from docloom.functions import text as T
from docloom.session import written
from docloom.sources.collection import Collection

REPLY = "request_id string, reply string, error string, attempts int"
FORMAT = 'Reply with a JSON object: {"detailed_description": ..., "entity_info": {"entity_name": ..., "summary": ...}}'


class Processor(ABC):
    """What is particular to one kind of item; columns over ``text, captions, context``
    and, for chunks, ``description``."""

    kind: str

    @abstractmethod
    def prompt(self) -> Column: ...

    @abstractmethod
    def chunk(self) -> Column: ...

    def fallback(self) -> Column:
        """What stands for a description where a model gave none."""
        own = T.ws_normalize(F.coalesce(F.nullif("text", F.lit("")), F.array_join("captions", " "), F.lit("")))
        return F.coalesce(F.nullif(own, F.lit("")), F.lit(f"{self.kind} without text"))


class Described(Processor):
    def __init__(self, kind: str, task: str):
        self.kind, self.task = kind, task

    def prompt(self) -> Column:
        return F.concat_ws("\n", F.lit(self.task), F.concat(F.lit("Captions: "), T.format_list(F.col("captions"))), F.concat(F.lit("Content: "), F.coalesce("text", F.lit(""))), F.concat(F.lit("Context: "), F.coalesce("context", F.lit(""))), F.lit(FORMAT))

    def chunk(self) -> Column:
        return F.concat_ws("\n", F.lit(self.kind.capitalize()), F.concat(F.lit("Captions: "), T.format_list(F.col("captions"))), F.concat(F.lit("Content: "), F.coalesce("text", F.lit(""))), F.concat(F.lit("Analysis: "), "description"))


PROCESSORS = {p.kind: p for p in (Described("image", "Describe the image."), Described("table", "Describe what the table says."), Described("equation", "Explain the equation."))}


def _by_kind(processors: dict[str, Processor], of) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, p in processors.items():
        out = out.when(F.col("kind") == kind, of(p))
    return out


def prepared(items: DataFrame, processors: dict[str, Processor] = PROCESSORS) -> DataFrame:
    """``items(document_id, item_id, kind, text, captions, context)`` with ``prompt``
    and ``request_id``.  A kind without a processor is an error."""
    known = F.col("kind").isin(list(processors))
    kind = F.when(F.coalesce(known, F.lit(False)), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no processor for "), F.coalesce("kind", F.lit("null")))))
    x = items.withColumn("kind", kind).withColumn("prompt", _by_kind(processors, lambda p: p.prompt()))
    return x.withColumn("request_id", F.sha2(F.concat_ws("\x1f", "kind", "prompt"), 256))


def _asking(model: M.TextModel):
    def run(frames):
        for pdf in frames:
            rows = []
            for ident, prompt, attempts in zip(pdf["request_id"], pdf["prompt"], pdf["attempts"]):
                try:
                    rows.append((ident, model.complete([prompt])[0], None, attempts + 1))
                except Exception as e:  # what a model's client raises is its own; the request is tried again
                    rows.append((ident, None, str(e) or type(e).__name__, attempts + 1))
            yield pd.DataFrame(rows, columns=["request_id", "reply", "error", "attempts"])

    return run


def asked(requests: DataFrame, models: dict[str, M.TextModel], store: Collection, rounds: int = 2) -> DataFrame:
    """Replies to all requests, ``(request_id, reply, error, attempts)``; known good
    ones are not asked again.  ``models`` has one by kind; a kind without one is an
    error of its requests."""
    spark = requests.sparkSession
    one = requests.select("request_id", "kind", "prompt").distinct()  # equal items meet before they are sorted
    one = written(one.groupBy("request_id").agg(F.min("kind").alias("kind"), F.min("prompt").alias("prompt")), "requests")
    if not store._commits():
        store.replace(spark.createDataFrame([], REPLY))
    for _ in range(rounds):
        known = store.read()
        left = one.join(known.where("reply is not null").select("request_id"), "request_id", "left_anti").join(known.select("request_id", "attempts"), "request_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        got = None
        for kind, model in models.items():
            part = left.where(F.col("kind") == kind).select("request_id", "prompt", "attempts").mapInPandas(_asking(model), REPLY)
            got = part if got is None else got.unionByName(part)
        none = left.where(~F.col("kind").isin(list(models))).select("request_id", F.lit(None).cast("string").alias("reply"), F.concat(F.lit("no model for "), "kind").alias("error"), (F.col("attempts") + 1).alias("attempts"))
        store.upsert(none if got is None else got.unionByName(none))
        if store.read().join(one.select("request_id"), "request_id", "left_semi").where("reply is null").isEmpty():
            break
    return store.read().join(one.select("request_id"), "request_id", "left_semi")


def analysed(requests: DataFrame, replies: DataFrame, processors: dict[str, Processor] = PROCESSORS) -> DataFrame:
    """``document_id, item_id, kind, description, entity_name, summary, parsed,
    chunk_text``.  Two analyses of one item are an error.  Replies are parsed before they
    meet their items, and the count of an item's analyses takes only its ids along."""
    bare = T.strip_thinking(F.coalesce("reply", F.lit("")))
    got = replies.select("request_id", bare.alias("_bare")).withColumn("_got", T.first_object(F.col("_bare")))
    field = lambda path: T.strip(F.coalesce(F.get_json_object("_got", path), F.lit("")))
    got = got.withColumns({"_d": field("$.detailed_description"), "_n": field("$.entity_info.entity_name"), "_s": field("$.entity_info.summary")})
    got = written(got.drop("_got"), "parsed")
    parsed = (F.col("_d") != "") & (F.col("_n") != "") & (F.col("_s") != "")
    x = requests.join(got, "request_id", "left").withColumn("parsed", F.coalesce(parsed, F.lit(False)))
    x = x.withColumn("description", F.when(F.col("parsed"), F.col("_d")).otherwise(F.coalesce(F.nullif("_bare", F.lit("")), _by_kind(processors, lambda p: p.fallback()))))
    plain = T.ws_normalize(F.col("description"))
    short = F.when(F.length(plain) <= 200, plain).otherwise(F.concat(F.regexp_replace(F.substring(plain, 1, 197), r"(?U)\s+\z", ""), F.lit("...")))
    own_name = F.concat(F.col("kind"), F.lit("-"), F.substring(F.sha2(F.concat_ws(chr(31), "item_id"), 256), 1, 24))
    x = x.withColumn("entity_name", F.when(F.col("parsed"), F.col("_n")).otherwise(own_name)).withColumn("summary", F.when(F.col("parsed"), F.col("_s")).otherwise(short))
    x = x.withColumn("chunk_text", _by_kind(processors, lambda p: p.chunk()))
    n = x.groupBy("document_id", "item_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    twice = n.agg(F.min(F.coalesce("item_id", F.lit("null"))).alias("_twice"))  # one row
    once = F.when(F.col("_twice").isNull(), F.col("item_id")).otherwise(F.raise_error(F.concat(F.lit("two analyses of "), "_twice")))
    x = x.crossJoin(F.broadcast(twice)).withColumn("item_id", once)
    return x.select("document_id", "item_id", "kind", "description", "entity_name", "summary", "parsed", "chunk_text")


def graph(analyses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, entities, edges) of the analyses: one chunk an item, one entity each,
    ``name (kind)``, a hub a document, and edges of weight 10 to it."""
    chunk_id = T.stable_id("chunk", F.col("document_id"), F.col("item_id"))
    hub = F.concat(F.lit("DOCUMENT::"), "document_id")
    x = analyses.withColumn("chunk_id", chunk_id).withColumn("hub", hub).withColumn("entity", F.concat("entity_name", F.lit(" ("), "kind", F.lit(")")))
    chunks = x.select("chunk_id", "document_id", F.col("chunk_text").alias("text"))
    own = x.groupBy("document_id", F.col("entity").alias("name")).agg(F.min_by("summary", "chunk_id").alias("description"), F.array_sort(F.collect_set("chunk_id")).alias("sources"), F.first("kind").alias("type"))
    hubs = x.groupBy("document_id", F.col("hub").alias("name")).agg(F.lit("document").alias("type"), F.array_sort(F.collect_set("chunk_id")).alias("sources"), F.min("document_id").alias("description"))
    entities = own.select("document_id", "name", "type", "description", "sources").unionByName(hubs.select("document_id", "name", "type", "description", "sources"))
    edges = x.groupBy("document_id", F.col("entity").alias("src"), F.col("hub").alias("tgt")).agg(F.lit("belongs_to").alias("keywords"), F.lit(10.0).alias("weight"), F.array_sort(F.collect_set("chunk_id")).alias("sources"))
    return chunks, entities, edges
