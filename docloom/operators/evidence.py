"""Evidence channels: lookups, merges and bounded graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "<SEP>"
ENTITY_WEIGHT, RELATION_WEIGHT, DECAY, NEIGHBOURS = 0.9, 0.85, 0.8, 20


def source_ids(df: DataFrame, column: str = "source_id") -> DataFrame:
    """One row per non-blank id of a joined list, distinct."""
    ids = F.filter(F.transform(F.split(F.col(column), SEP), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("chunk_id", F.explode(F.array_distinct(ids)))


def pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def first_by(value, seq: str = "seq") -> Column:
    """Value of the first row by seq (ties cannot choose: seq is in the key)."""
    return F.min_by(value, F.col(seq))


def merge(candidates: DataFrame, keys: list[str], first: list[str] = (), union: list[str] = ()) -> DataFrame:
    """Greatest score, all channels, the first record and the union of lists."""
    aggs = [F.max("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"), F.min("seq").alias("first_seq")]
    aggs += [first_by(F.col(c)).alias(c) for c in first]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union]
    return candidates.groupBy(*keys).agg(*aggs)


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 1, decay: float = DECAY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Bounded breadth-first expansion.

    ``seeds(node, score)``, ``edges(src, tgt, seq)`` undirected -> ``(node,
    score, edge_src, edge_tgt, step)``.  Each node not yet expanded takes its
    first ``neighbours`` edges by seq (ranked per node of the frontier only, with
    a limit that Spark applies before it shuffles); edge and neighbour score is
    score * decay**(step+1) of the frontier's seed score; a node reached often
    keeps the greatest score.  Depth is a small constant, so the loop only
    builds the plan.
    """
    both = edges.select(F.col("src").alias("node"), F.col("tgt").alias("other"), "src", "tgt", "seq").unionByName(
        edges.where("src <> tgt").select(F.col("tgt").alias("node"), F.col("src").alias("other"), "src", "tgt", "seq")
    )
    w = Window.partitionBy("node").orderBy("seq", "other")
    frontier = seeds.groupBy("node").agg(F.max("score").alias("score"))
    done, out = frontier.select("node"), None
    for step in range(depth):
        own = both.join(frontier, "node")  # edges of other nodes are not ranked
        near = own.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= neighbours)
        found = near.select("other", F.col("src").alias("edge_src"), F.col("tgt").alias("edge_tgt"), (F.col("score") * F.pow(F.lit(decay), F.lit(step + 1))).alias("score"))
        found = found.withColumn("step", F.lit(step + 1)).withColumnRenamed("other", "node")
        out = found if out is None else out.unionByName(found)
        if step + 1 < depth:
            frontier = found.groupBy("node").agg(F.max("score").alias("score")).join(done, "node", "left_anti")
            done = done.unionByName(frontier.select("node"))
    return out
