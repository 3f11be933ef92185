"""PageRank, influence, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.scores import capped_ratio
from talewind.operators.skew import dealt_once
from talewind.session import cut_lineage

DAMPING, ROUNDS, TOLERANCE = 0.85, 50, 1e-7
ROUNDS_PER_CUT = 5
# Weights and caps of the influence score.
RANK_CAP, AMPLIFICATION_CAP, BETWEENNESS_CAP, NARRATIVE_CAP = 0.01, 1000, 10000, 20
BRIDGE_SCORE, BRIDGES_KEPT = 0.3, 1000


def pagerank(
    edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
    nodes: DataFrame | None = None, rows_per_piece: int | None = None,
) -> DataFrame:
    """Weighted PageRank: actor_id, pagerank (sums to 1). ``edges``: src, dst, weight; ``nodes`` adds isolated actors.

    rank = (1 - d) + d * sum(rank of source * its share of the source's outgoing weight). Links are dealt out by source once and
    stay where they lie; a round moves the ranks to them and one partially aggregated sum per target. In the last round before a cut the old
    rank rides along in the same aggregation, so the change is known without a further join. Sources with very many edges are cut into pieces.
    """
    merged = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    merged = cut_lineage(merged.filter(F.col("weight") > 0))
    out = merged.groupBy("src").agg(F.sum("weight").alias("_out"))
    links, met = dealt_once(merged, "src", "dst", rows_per_piece, known_rows=merged.count(), beside=out)
    names = merged.select(F.col("src").alias("actor_id")).unionByName(merged.select(F.col("dst").alias("actor_id")))
    if nodes is not None:
        names = names.unionByName(nodes.select("actor_id"))
    names = cut_lineage(names.distinct())
    ranks = names.withColumn("rank", F.lit(1.0 - damping)).withColumn("old", F.lit(0.0))
    done = 0
    while done < rounds:
        block = min(ROUNDS_PER_CUT, rounds - done)
        for i in range(block):
            given = met(ranks.select(F.col("actor_id").alias("src"), "rank")).select(
                F.col("dst").alias("actor_id"), (F.col("rank") * (F.col("weight") / F.col("_out"))).alias("gain"), F.lit(0.0).alias("old")
            )
            # Every node stays. Only the last round reads the old ranks: in all rounds the plan would double from each to the next.
            old = ranks.select("actor_id", F.col("rank").alias("old")) if i == block - 1 else names.select("actor_id", F.lit(0.0).alias("old"))
            ranks = given.unionByName(old.withColumn("gain", F.lit(0.0))).groupBy("actor_id").agg(
                (F.lit(1.0 - damping) + F.lit(damping) * F.sum("gain")).alias("rank"), F.max("old").alias("old")
            )
        done += block
        ranks = cut_lineage(ranks)
        change = ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if change is None or change < tolerance:
            break
    links.unpersist()
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("actor_id", (F.col("rank") / F.lit(total or 1.0)).alias("pagerank"))


def influence_scores(actors: DataFrame) -> DataFrame:
    """Composite influence and bridge score from pagerank, amplification_score, betweenness, narrative_count."""
    bridge = capped_ratio("betweenness", BETWEENNESS_CAP)
    influence = (
        0.30 * capped_ratio("pagerank", RANK_CAP) + 0.25 * capped_ratio("amplification_score", AMPLIFICATION_CAP)
        + 0.25 * bridge + 0.20 * capped_ratio("narrative_count", NARRATIVE_CAP)
    )
    return actors.withColumn("influence_score", influence).withColumn("bridge_score", bridge)


def top_bridges(actors: DataFrame, limit: int = BRIDGES_KEPT, min_score: float = BRIDGE_SCORE) -> DataFrame:
    return actors.filter(F.col("bridge_score") > min_score).orderBy(F.desc("bridge_score"), F.asc("actor_id")).limit(limit)
