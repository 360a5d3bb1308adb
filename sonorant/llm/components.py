"""Connected components of an edge table, by repeated contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.llm.common import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for each node of edges (a, b): root is one node of its component, the same for all.

    Each round sends every node to its smallest neighbour and contracts the edges; star-shaped input needs one or two.
    Only edge tables move; nothing is collected but whether edges are left.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node"), "contract")
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct()
        edges = materialise(moved, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].withColumnRenamed("to", "root")
    for m in maps[1:]:
        out = out.join(m.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
