"""Look-ups over the actor graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.operators.skew import top_per_group

SUMMARIES_KEPT, SAMPLE_PLATFORMS = 500, 5
HISTORY_PER_PLATFORM, HISTORY_SHOWN = 100, 200


def community_summary(actors: DataFrame, limit: int = SUMMARIES_KEPT) -> DataFrame:
    """Size, up to five platforms and mean influence of the largest communities."""
    known = actors.filter(F.col("community_id").isNotNull())
    # Platforms are a closed list, so the set is small in any community.
    summary = known.groupBy("community_id").agg(
        F.count("*").alias("member_count"),
        F.slice(F.array_sort(F.collect_set("primary_platform")), 1, SAMPLE_PLATFORMS).alias("sample_platforms"),
        F.avg("influence_score").alias("avg_influence"),
    )
    return summary.orderBy(F.desc("member_count"), F.asc("community_id")).limit(limit)


def network_stats(actors: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge count in one row."""
    n = actors.select(F.lit(1).alias("node"), F.lit(0).alias("edge"))
    e = edges.select(F.lit(0).alias("node"), F.lit(1).alias("edge"))
    both = n.unionByName(e).agg(F.sum("node").alias("n"), F.sum("edge").alias("e"))
    return both.select(F.coalesce("n", F.lit(0)).alias("node_count"), F.coalesce("e", F.lit(0)).alias("edge_count"))


def subgraph(
    actors: DataFrame, edges: DataFrame, community_id: object = None, min_influence: float = 0.0, platform: str | None = None,
    limit: int = 500, edge_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the most influential actors that pass the filters, and the edges among them."""
    nodes = actors
    if community_id is not None:
        nodes = nodes.filter(F.col("community_id") == F.lit(community_id))
    if min_influence > 0:
        nodes = nodes.filter(F.col("influence_score") >= min_influence)
    if platform is not None:
        nodes = nodes.filter(F.col("primary_platform") == platform)
    nodes = nodes.orderBy(F.desc("influence_score"), F.asc("actor_id")).limit(limit)
    ids = nodes.select("actor_id")
    inside = edges.join(ids.withColumnRenamed("actor_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("actor_id", "dst"), "dst", "left_semi"
    ).select("src", "dst", "edge_type", "weight", "interaction_count")
    if edge_limit is not None:
        inside = inside.orderBy(F.desc("weight"), "src", "dst", "edge_type").limit(edge_limit)
    return nodes, inside


def actor_profile(actors: DataFrame, edges: DataFrame, links: DataFrame, actor_id: object) -> DataFrame:
    """Properties, connections out and in, and the accounts linked to the actor.

    ``links``: actor_a, actor_b (same person). The look-up touches one key, so every part is a pushed-down filter.
    """
    me = F.lit(actor_id)
    out = edges.filter(F.col("src") == me).groupBy(F.col("src").alias("actor_id")).agg(F.count("*").alias("_out"))
    into = edges.filter(F.col("dst") == me).groupBy(F.col("dst").alias("actor_id")).agg(F.count("*").alias("_in"))
    there = links.filter(F.col("actor_a") == me).select(F.col("actor_a").alias("actor_id"), F.col("actor_b").alias("_other"))
    back = links.filter(F.col("actor_b") == me).select(F.col("actor_b").alias("actor_id"), F.col("actor_a").alias("_other"))
    named = actors.select(F.col("actor_id").alias("_other"), "username", "primary_platform")
    other = there.unionByName(back).distinct().join(named, "_other")
    linked = other.groupBy("actor_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_other").alias("actor_id"), "username", "primary_platform"))).alias("_linked")
    )
    profile = actors.filter(F.col("actor_id") == me)
    joined = profile.join(out, "actor_id", "left").join(into, "actor_id", "left").join(linked, "actor_id", "left")
    nobody = F.expr("filter(array(named_struct('actor_id', '', 'username', '', 'primary_platform', '')), x -> false)")
    return joined.select(
        *actors.columns, F.coalesce("_out", F.lit(0)).alias("outgoing_connections"),
        F.coalesce("_in", F.lit(0)).alias("incoming_connections"), F.coalesce("_linked", nobody).alias("linked_accounts"),
    )


def actor_history(posts: DataFrame, actor_id: object, per_platform: int = HISTORY_PER_PLATFORM, limit: int = HISTORY_SHOWN) -> DataFrame:
    """Latest posts of an account, at most ``per_platform`` per platform, newest first."""
    own = posts.filter(F.col("actor_id") == F.lit(actor_id))
    recent = top_per_group(own, ["platform"], [F.desc("created_at"), F.desc("content_id")], per_platform).drop("rank")
    return recent.orderBy(F.desc("created_at"), F.desc("content_id")).limit(limit)
