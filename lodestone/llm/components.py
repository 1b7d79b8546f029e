"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, settle


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that it is connected to.

    Rounds of large and small stars: each node's larger, then its smaller neighbours are hung on the smallest of all. The
    work of a round is two aggregates and two joins; rounds grow with the logarithm of the number of nodes. A round's minima
    are settled, so that Spark deals both sides of a join itself and can split a node that has very many neighbours."""

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1000003)).first())

    now = settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    same = told(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("root")).select("a", F.least("root", "a").alias("root")))
        large = settle(both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").distinct())
        # now a < b throughout: hang each node's smaller neighbours, and itself, on the smallest
        small = settle(large.groupBy("b").agg(F.min("a").alias("root")))
        hung = large.join(small, "b").select("root", F.explode(F.array("a", "b")).alias("b")).filter("root <> b").select(F.col("root").alias("a"), "b").distinct()
        after = settle(hung)
        discard(now, least, large, small)
        before, same, now = same, told(after), after
        if before == same:
            break
    else:
        raise RuntimeError(f"components: not stable after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
