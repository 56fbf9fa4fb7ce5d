"""Tables keyed by document: rows of a document are replaced as a whole.

Saving appends the new rows under a higher ``version``; reading takes each
document's last one.  Nothing is rewritten in place, so a lost task or a save
that fails half-way leaves the rows of before, and readers never see a mixture
of two saves.  Stores of documents, analyses, analysis requests and chunks
differ only in their columns.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


def last_version(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows of each key's highest ``version``, without that column."""
    last = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(last, [key, "version"], "left_semi").drop("version")


def save(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """All documents' rows or those of one; an unknown document is an error."""
    rows = spark.read.parquet(path)
    if document_id is None:
        return last_version(rows)
    own = last_version(rows.where(F.col("document_id") == document_id))
    if own.isEmpty():
        raise FileNotFoundError(f"nothing stored for document {document_id!r} in {path}")
    return own


def mismatched(children: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows that name a document which the store does not hold."""
    return children.join(documents.select(key).distinct(), key, "left_anti")


def checked(children: DataFrame, document_id: str, key: str = "document_id") -> DataFrame:
    """``children`` as they are; reading a row of another document is an error."""
    wrong = F.raise_error(F.concat(F.lit("document id mismatch: "), F.coalesce(F.col(key), F.lit("null"))))
    return children.withColumn(key, F.when(F.col(key) == document_id, F.col(key)).otherwise(wrong))


class CustomKGStore(Protocol):
    """Takes the payload of one document or of many: chunks, entities and
    relationships that carry ``document_id``."""

    def insert(self, chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> None: ...


class ParquetKGStore:
    """A knowledge graph as three tables below one root, read by
    ``operators.evidence`` and merged there by name and by pair."""

    def __init__(self, spark: SparkSession, root: str, version: int):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def insert(self, chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> None:
        """Chunks last: a document counts as loaded once its chunks are there."""
        for df, name in ((entities, "nodes"), (relationships, "edges"), (chunks, "chunks")):
            save(df, f"{self.root}/{name}", self.version)

    def table(self, name: str) -> DataFrame:
        """Rows of ``nodes`` and ``edges`` count only under the version of their
        document's chunks."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        live = self.spark.read.parquet(f"{self.root}/chunks").groupBy("document_id").agg(F.max("version").alias("version"))
        return rows.join(live, ["document_id", "version"], "left_semi").drop("version")


def brief(text: Column, limit: int = 180) -> Column:
    """A chunk's text on one line, cut for a trace."""
    line = T.strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def traces(answered: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """``key, trace``: one JSON record a question, its chunks in brief, by score."""
    chunk = F.struct("chunk_id", "score", brief(F.col("text")).alias("text_preview"))
    best = evidence.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("score").alias("_s"), chunk.alias("c"))), asc=False).alias("x"))
    best = best.select(key, F.transform("x", lambda v: v["c"]).alias("final_chunks"))
    rows = answered.join(best, key, "left").withColumn("final_chunks", F.coalesce("final_chunks", F.array()))
    fields = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(key, *fields)).alias("trace"))


def write_traces(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.select(F.col("trace").alias("value")).write.mode(mode).text(path)


def listed(value: Column) -> Column:
    """Comma-separated words as a list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: T.strip(x)), lambda x: x != "")


def entity_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of ``name, type, description``: trimmed, type in lower
    case; blank fields are refused."""
    s = {c: T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "type", "description")}
    r = rows.withColumns(s | {"type": F.lower(s["type"])})
    ok = (F.col("name") != "") & (F.col("type") != "") & (F.col("description") != "")
    return r.where(ok), r.where(~ok)


def relationship_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of ``source, target, description, keywords, weight``:
    keywords become a list, a weight of null or zero is 1, others must be positive."""
    s = {c: T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "target", "description")}
    weight = F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0))
    r = rows.withColumns(s | {"keywords": listed(F.col("keywords")), "weight": weight})
    ok = (F.col("source") != "") & (F.col("target") != "") & (F.col("description") != "") & (F.col("weight") > 0)
    return r.where(ok), r.where(~ok)
