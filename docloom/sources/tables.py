"""Readers and writers: text trees, JSON lines, CSV questions, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The longest pre-chunked text that an ingest accepts.
LONGEST = 8192


def read_manuals(spark: SparkSession, root: str) -> DataFrame:
    """All .md and .txt files below a folder: ``path, manual_id, text``."""
    t = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    path = F.col("_metadata.file_path")
    return t.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).alias("manual_id"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions and answers, first of equal questions, original
    numbers kept; an entry without a question or an answer is an error."""
    raw = spark.read.schema("idx long, question string, answer string").json(path, multiLine=True)
    blank = lambda c: F.raise_error(F.concat(F.lit(f"FAQ entry without {c}: "), F.coalesce(F.col("idx").cast("string"), F.lit("?")))).cast("string")
    own = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), blank(c)).alias(c)
    ok = raw.select("idx", own("question"), own("answer"))
    w = Window.partitionBy("question").orderBy("idx")
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``id, question`` with quoted line breaks; a bad id becomes -1."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="id string, question string")
    return raw.select(F.coalesce(F.col("id").try_cast("int"), F.lit(-1)).alias("id"), "question")


def id_range(rows: DataFrame, column: str, first: int | None = None, last: int | None = None) -> DataFrame:
    ident = F.coalesce(F.col(column).try_cast("int"), F.lit(-1))
    out = rows
    if first is not None:
        out = out.where(ident >= first)
    return out if last is None else out.where(ident <= last)


def checked_chunks(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused are blank or over-long texts."""
    ok = (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (F.length(text) <= LONGEST)
    return rows.where(ok), rows.where(~ok)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def first_chunks(chunks: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` chunks in order; all where no limit is given."""
    if limit is None:
        return chunks
    if limit <= 0:
        raise ValueError("limit must be positive")
    return chunks.orderBy(order).limit(limit)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do; safe for unsorted and repeated ids, unlike a maximum."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def same_manifest(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``fresh``: all columns equal, nulls equal to nulls."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.alias("a").crossJoin(b.alias("b")).select(cond.alias("fresh"))  # one row each


def read_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """Binary documents through a parser plug-in ``parse(path, bytes) -> rows of
    (page_idx, order_idx, type, text)``."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page_idx", "order_idx", "type", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page_idx int, order_idx int, type string, text string")
