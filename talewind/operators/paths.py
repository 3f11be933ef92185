"""Shortest paths between two actors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.session import cut_lineage

MAX_HOPS = 10


def shortest_path(edges: DataFrame, start: object, goal: object, max_hops: int = MAX_HOPS) -> DataFrame:
    """One shortest undirected path as rows: step, actor_id, edge_type, weight (the edge that led to the actor).

    No rows where the goal is not reached within ``max_hops``. Of equal paths the one over the smallest actors, and of
    parallel edges the heaviest, is taken. Breadth first: each hop joins the frontier with the edges, keeps one parent
    per new node and drops nodes already seen.
    """
    kind = edges.schema["src"].dataType
    # Written once: every hop reads the edges, and making them may be dear.
    there = cut_lineage(edges.select("src", "dst", "edge_type", F.col("weight").cast("double").alias("weight")))
    back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight")
    links = there.unionByName(back).filter(F.col("src") != F.col("dst"))
    spark = edges.sparkSession
    root = spark.range(1).select(
        F.lit(start).cast(kind).alias("actor_id"), F.lit(None).cast(kind).alias("parent"),
        F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("double").alias("weight"),
    )
    levels = [cut_lineage(root)]
    visited = levels[0].select("actor_id")
    found = start == goal
    while not found and len(levels) <= max_hops:
        front = levels[-1].select(F.col("actor_id").alias("src"))
        best = F.min_by(F.struct("src", "edge_type", "weight"), F.struct("src", -F.col("weight"), "edge_type")).alias("_b")
        reached = links.join(front, "src").groupBy(F.col("dst").alias("actor_id")).agg(best)
        fresh = cut_lineage(
            reached.join(visited, "actor_id", "left_anti").select(
                "actor_id", F.col("_b.src").alias("parent"), F.col("_b.edge_type").alias("edge_type"), F.col("_b.weight").alias("weight")
            )
        )
        if fresh.isEmpty():
            break
        levels.append(fresh)
        visited = visited.unionByName(fresh.select("actor_id"))
        found = not fresh.filter(F.col("actor_id") == F.lit(goal).cast(kind)).isEmpty()
    if not found:
        return root.limit(0).select(F.lit(0).alias("step"), "actor_id", "edge_type", "weight")
    here = levels[-1].filter(F.col("actor_id") == F.lit(goal).cast(kind))
    path = here.select(F.lit(len(levels) - 1).alias("step"), "actor_id", "edge_type", "weight")
    for step in range(len(levels) - 2, -1, -1):
        parent = here.select(F.col("parent").alias("actor_id"))
        here = levels[step].join(parent, "actor_id")
        path = path.unionByName(here.select(F.lit(step).alias("step"), "actor_id", "edge_type", "weight"))
    return path
