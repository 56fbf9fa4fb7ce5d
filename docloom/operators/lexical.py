"""Inverted index and BM25 (Okapi) as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25


#: Shares of a score are summed as whole numbers of this part, so that sums do not
#: depend on their order.
PART = 1e12
#: Bits of the lower part of a whole number, where two parts are summed.
LOW = 30


def whole(x) -> Column:
    return F.floor(x * PART + 0.5)


def total(x: Column) -> Column:
    """The exact sum of whole numbers, as a double.  The sum may pass a long (some
    700,000 terms' idf do), so upper and lower bits are summed apart; those of
    10^9 rows fit."""
    high, low = F.sum(F.shiftright(x, LOW)), F.sum(x.bitwiseAND(F.lit((1 << LOW) - 1).cast("long")))
    return (high.cast("decimal(20,0)") * F.lit(1 << LOW).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("double")


def counted(docs: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """``(id, dl, terms)``: how many words each row has, and its distinct ones with
    their frequency, sorted and counted in runs, so no row leaves its task."""
    own = docs.select(id_col, F.sort_array(F.col(words_col)).alias("_w")).withColumn("dl", F.size("_w").cast("long"))
    places = F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.size("_w") - 1))
    own = own.withColumn("_at", F.coalesce(F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))), F.array().cast("array<int>")))
    following = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_w")))
    runs = F.zip_with("_at", F.slice(following, F.lit(1), F.size("_at")), lambda i, j: F.struct(F.get("_w", i).alias("term"), (j - i).cast("long").alias("tf")))
    return own.select(id_col, "dl", runs.alias("terms"))


def _postings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, dl, term, tf)``."""
    own = counted(docs.select(id_col, T.tokens(F.col(text_col)).alias("_words")), id_col, "_words")
    # outer: from an inner explode Spark infers a filter on the array, and would count each text once per word for it
    return own.select(id_col, "dl", F.explode_outer("terms").alias("_p")).where("_p is not null").select(id_col, "dl", "_p.term", "_p.tf")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, term, tf)``."""
    return _postings(docs, id_col, text_col).select(id_col, "term", "tf")


def raw_idf(n, df) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def mean_idf(terms: DataFrame) -> DataFrame:
    """One row, ``mean`` of ``terms(raw)``."""
    return terms.agg((total(whole(F.col("raw"))) / PART / F.count(F.lit(1))).alias("mean"))


def _raw(post: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    terms = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses")).crossJoin(F.broadcast(n))
    return terms.withColumn("raw", raw_idf(F.col("n"), F.col("df")))


def floored(raw, mean) -> Column:
    """Negative values become a share of the mean."""
    return F.when(raw < 0, EPSILON * mean).otherwise(raw)


def saturation(tf, dl, avgdl) -> Column:
    """How far a frequency carries: rises with it, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def idf(post: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, df, idf)``; negative values become a share of the mean."""
    raw = _raw(post, docs)
    return raw.crossJoin(F.broadcast(mean_idf(raw))).select("term", "df", floored(F.col("raw"), F.col("mean")).alias("idf"))


def impacts(docs: DataFrame, id_col: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """The index: ``(term, id, w)``, each posting's share of a document's score;
    of the given terms only, if any are given.  Documents are read for their
    postings and once more for the counts of all terms, from which the mean idf
    and the mean length also come; only the counts are shuffled whole."""
    post = _postings(docs, id_col)
    raw = _raw(post, docs)
    means = mean_idf(raw).crossJoin(raw.agg((F.sum("uses") / F.first("n")).alias("avgdl")))  # one row each
    used = post if terms is None else post.join(terms.select("term").distinct(), "term", "left_semi")
    weight = saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return used.join(raw.crossJoin(F.broadcast(means)), "term").select("term", id_col, (floored(F.col("raw"), F.col("mean")) * weight).alias("w"))


def query_terms(queries: DataFrame, query_id: str, text_col: str = "text") -> DataFrame:
    words = queries.select(query_id, F.explode(T.tokens(F.col(text_col))).alias("term"))
    return words.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qf"))


def search(index: DataFrame, terms: DataFrame, id_col: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    return index.join(terms, "term").groupBy(query_id, id_col).agg(summed(F.col("w"), F.col("qf")).alias("score"))


def summed(w, qf) -> Column:
    """The score of shares ``w`` of terms that a query has ``qf`` times."""
    return total(whole(w) * qf) / PART


def scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """``(query, id, score)`` of all documents that share a term.  Repeated query
    terms count repeatedly.  One shuffle of postings by term, one of partial
    sums by (query, document)."""
    terms = query_terms(queries, query_id)
    return search(impacts(docs, id_col, terms), terms, id_col, query_id)


def top_k(scored: DataFrame, key: str, k: int, id_col: str = "doc_id", positive: bool = True) -> DataFrame:
    """Best k per key, ties by id; only then are non-positive scores dropped."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(id_col))
    out = scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return out.where("score > 0") if positive else out
