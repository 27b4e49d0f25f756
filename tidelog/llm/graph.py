"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import splittable, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b): each node links its larger (large) or smaller neighbours to its least one.

    The minima are a map-side aggregation, and edges meet them in an equi-join whose one side has
    one row for each node and a shuffle of its own, so that a node with many neighbours can be split.
    """
    if large:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        linked = pairs.where("b > a").join(splittable(least, "a"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        linked = down.join(splittable(least, "a"), "a").select("b", F.col("least")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        linked = linked.unionAll(least.select("a", F.col("least").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root of every node of the edges (a, b), both long; root is the component's least node.

    Edges may repeat, point either way, and link a node to itself (such a node is left out if it
    has no other edge). Each round is staged, so lineage stays short. An empty table gives an empty result.
    """
    current = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # a fixpoint has the same edges: equal in number and in two independent sums over them
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))
        ).first()
        if state[0] == 0 or state == last:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
        current = staged(_star(_star(current, True), False), "edges")
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
