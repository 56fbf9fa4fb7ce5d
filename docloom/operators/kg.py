"""Knowledge-graph building: merges, folds and reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

LIMIT = 2000


def distinct_in_order(value: Column, seq: Column) -> Column:
    """Distinct values, first seen first (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), value.alias("x"))))
    return F.array_distinct(F.transform(rows, lambda s: s["x"]))


def capped(text: Column, limit: int = LIMIT) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+\z", ""), F.lit("...")))


def merge_entities(rows: DataFrame) -> DataFrame:
    """``rows(name, type, description, seq)`` merged by case-folded name: first
    name and type, distinct descriptions in order, joined and capped.  Equal
    descriptions meet in partial sums before any list is made."""
    keyed = rows.withColumn("key", T.casefold_key(F.col("name")))
    one = keyed.groupBy("key", "description").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.count(F.lit(1)).alias("n"))
    return one.groupBy("key").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"),
        capped(F.array_join(distinct_in_order(F.col("description"), F.col("seq")), " ")).alias("description"), F.sum("n").alias("mentions"),
    )


def merge_relationships(rows: DataFrame) -> DataFrame:
    """``rows(src, tgt, description, keyword, weight, seq)`` by undirected pair:
    greatest weight, distinct descriptions and keywords in order; the first
    direction stays; self-loops stay; no keyword at all becomes related_to.
    Equal pairs of both meet in partial sums before any list is made."""
    a, b = T.casefold_key(F.col("src")), T.casefold_key(F.col("tgt"))
    told = rows.groupBy("src", "tgt", "description", "keyword").agg(F.min("seq").alias("seq"), F.max("weight").alias("weight"))  # names are folded once, numbers meet in hash tables
    keyed = told.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))
    one = keyed.groupBy("a", "b", "description", "keyword").agg(F.min("seq").alias("seq"), F.min_by("src", "seq").alias("src"), F.min_by("tgt", "seq").alias("tgt"), F.max("weight").alias("weight"))
    words = F.array_join(F.filter(distinct_in_order(F.col("keyword"), F.col("seq")), lambda k: k != ""), ",")
    return one.groupBy("a", "b").agg(
        F.min_by("src", "seq").alias("src"), F.min_by("tgt", "seq").alias("tgt"), F.max("weight").alias("weight"),
        F.array_join(distinct_in_order(F.col("description"), F.col("seq")), " ").alias("description"), F.coalesce(F.nullif(words, F.lit("")), F.lit("related_to")).alias("keywords"),
    )


def in_chunk_relationships(rows: DataFrame, key: str) -> DataFrame:
    """Within a chunk: no self-loops, weight (null or 0: 1) kept in 1..10."""
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    ok = rows.where(T.casefold_key(F.col("src")) != T.casefold_key(F.col("tgt"))).withColumn("weight", F.least(F.greatest(w, F.lit(1.0)), F.lit(10.0)))
    a, b = T.casefold_key(F.col("src")), T.casefold_key(F.col("tgt"))
    g = ok.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b)).groupBy(key, "a", "b")
    words = F.array_join(F.filter(distinct_in_order(F.col("keyword"), F.col("seq")), lambda k: k != ""), ",")
    return g.agg(F.max("weight").alias("weight"), F.coalesce(F.nullif(words, F.lit("")), F.lit("related_to")).alias("keywords"))


def append_if_absent(rows: DataFrame, key: str) -> DataFrame:
    """``rows(key, text, seq)``: texts in order, each appended unless it is part
    of what was gathered before."""
    one = rows.groupBy(key, "text").agg(F.min("seq").alias("seq"))  # a repeat is part of what it repeats
    g = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("r"))
    fold = F.aggregate("r", F.lit(""), lambda s, x: F.when(s == "", x["text"]).when(F.contains(s, x["text"]), s).otherwise(F.concat(s, F.lit(" "), x["text"])))
    return g.select(key, fold.alias("text"))


def unique_names(rows: DataFrame, key: str, name: str, kind: str, ident: str) -> DataFrame:
    """``name (kind)``, with the last eight of the id for all but the least id."""
    first = rows.groupBy(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(kind).alias("_t")).agg(F.min(ident).alias("_first"))
    rows = rows.join(first, F.col(key).eqNullSafe(F.col("_k")) & F.col(name).eqNullSafe(F.col("_n")) & F.col(kind).eqNullSafe(F.col("_t")))
    base = F.concat(F.col(name), F.lit(" ("), F.col(kind), F.lit(")"))
    tail = F.concat(base, F.lit(" ["), F.expr(f"right({ident}, 8)"), F.lit("]"))
    return rows.withColumn("unique_name", F.when(F.col(ident) == F.col("_first"), base).otherwise(tail)).drop("_k", "_n", "_t", "_first")


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str, problem: str) -> DataFrame:
    """Rows whose reference does not exist, as (key, problem)."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(problem).alias("problem"))


def duplicates(rows: DataFrame, key: str, problem: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("key"), F.lit(problem).alias("problem"))
