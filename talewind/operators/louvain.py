"""Weighted community detection by modularity (Louvain)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.operators.skew import dealt_once, split_hot
from talewind.session import ROWS_PER_PIECE, cut_lineage

LEVELS, ITERATIONS = 10, 20
# An iteration or level that lifts modularity by less than this is the last.
TOLERANCE = 1e-4
_GAIN = 1e-9


def undirected_weights(edges: DataFrame) -> DataFrame:
    """Symmetric weights: u, v, w in both directions; a loop keeps its weight once per end."""
    merged = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
    merged = merged.groupBy("u", "v").agg(F.sum("weight").alias("w"))
    loops = merged.filter(F.col("u") == F.col("v")).select("u", "v", (F.col("w") * 2).alias("w"))
    plain = merged.filter(F.col("u") != F.col("v"))
    return plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionByName(loops)


def modularity(weights: DataFrame, labels: DataFrame) -> float:
    """Modularity of a labelling. ``weights``: u, v, w symmetric; ``labels``: node, label."""
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    lu = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    lv = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    both = weights.join(lu, "u").join(lv, "v")
    per = both.groupBy("lu").agg(
        F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree")
    )
    return per.agg(F.sum(F.col("inside") / total - (F.col("degree") / total) ** 2)).first()[0] or 0.0


def _moved(state: DataFrame, met: Callable[[DataFrame], DataFrame], total: float, rows: int, turn: Column, rows_per_piece: int | None) -> DataFrame:
    """One iteration: ``state`` with the labels after it, and ``inside``: each node's weight towards its own label *before* it.

    Weights lie by ``v`` (``dealt_once``). Each sends its node's label and that label's size on to ``u``, and this is the only time that rows as
    many as weights are moved: they are dealt by ``u``, where labels are added up and compared. Hubs are dealt by label, too.
    """
    sizes = state.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    cut, copy = split_hot(state, "label", "node", rows_per_piece, known_rows=rows)
    sized = cut.join(copy(sizes, "label"), ["label", "_piece"]).select("node", "k", "pieces", "label", "tot", "members")
    told = met(sized.select(F.col("node").alias("v"), F.col("label").alias("target"), F.col("tot").alias("to_tot"), F.col("members").alias("to_members")))
    part = F.pmod(F.hash("target"), F.col("u_pieces")).alias("part")
    sent = told.select(F.col("u").alias("node"), part, "target", "to_tot", "to_members", "w").repartition("node", "part")
    towards = sent.groupBy("node", "part", "target").agg(
        F.sum("w").alias("w"), F.first("to_tot").alias("to_tot"), F.first("to_members").alias("to_members")
    )
    own = sized.select("node", "k", "label", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
    rated = towards.join(own.hint("shuffle_hash"), ["node", "part"])
    home, gain = F.col("target") == F.col("label"), F.col("w") - F.col("k") * F.col("to_tot") / total
    ranked = F.struct((-F.round("gain", 9)).alias("order"), "target", "to_members", "gain")
    choice = (
        rated.withColumn("gain", gain).groupBy("node", "part")
        .agg(F.max(F.when(home, F.col("w"))).alias("inside"), F.min(F.when(~home, ranked)).alias("move"))
        .groupBy("node").agg(F.max("inside").alias("inside"), F.min("move").alias("move"))
    )
    inside = F.coalesce("inside", F.lit(0.0))
    stay = inside - F.col("k") * (F.col("tot") - F.col("k")) / total
    lone = (F.col("members") == 1) & (F.col("move.to_members") == 1)
    better = F.col("move.gain") > stay + _GAIN
    moves = turn & better & (~lone | (F.col("move.target") < F.col("label")))
    return sized.join(choice, "node", "left").select(
        "node", "k", "pieces", F.when(F.coalesce(moves, F.lit(False)), F.col("move.target")).otherwise(F.col("label")).alias("label"),
        inside.alias("inside"),
    )


def _one_level(
    weights: DataFrame, total: float, rows: int, iterations: int, level: int, rows_per_piece: int | None
) -> tuple[DataFrame, float]:
    """Local moves on one graph: (node, label) and the labelling's modularity.

    All nodes decide at once, so neighbours could swap for ever; in each iteration only one half of the nodes, by a
    hash that changes with the iteration, may move, and a lone node joins another lone node only towards the smaller
    label. Iterating stops when neither half lifts modularity any more; the best labelling is kept. A labelling's modularity comes from the
    iteration after it, which adds up the weights towards own labels anyway.
    """
    pieces = F.ceil(F.count("*") / (rows_per_piece or ROWS_PER_PIECE)).cast("int").alias("pieces")
    degree = cut_lineage(weights.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), pieces))
    hubs = degree.filter("pieces > 1").select(F.col("node").alias("u"), F.col("pieces").alias("u_pieces"))
    plain = weights.filter(F.col("u") != F.col("v")).join(F.broadcast(hubs), "u", "left").fillna(1, ["u_pieces"])
    loops = weights.filter(F.col("u") == F.col("v")).agg(F.sum("w")).first()[0] or 0.0
    kept, met = dealt_once(plain, "v", "u", rows_per_piece, known_rows=rows)
    state = degree.select("node", "k", "pieces", F.col("node").alias("label"))
    best, best_score = state, None
    for iteration in range(iterations + 1):
        turn = F.pmod(F.xxhash64("node", F.lit(level), F.lit(iteration)), F.lit(2)) == 0
        stepped = cut_lineage(_moved(state, met, total, rows, turn, rows_per_piece))
        if iteration % 2 == 0 or iteration == iterations:
            # Both halves have had their turn.
            inside = (stepped.agg(F.sum("inside")).first()[0] or 0.0) + loops
            shares = state.groupBy("label").agg((F.sum("k") / total).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
            score = inside / total - shares if total else 0.0
            gained = None if best_score is None else score - best_score
            if gained is None or gained > 0:
                best, best_score = state, score
            if gained is not None and gained <= TOLERANCE:
                break
        state = stepped.drop("inside")
    kept.unpersist()
    return best.select("node", "label"), best_score


def communities(
    edges: DataFrame, levels: int = LEVELS, iterations: int = ITERATIONS, rows_per_piece: int | None = None
) -> DataFrame:
    """actor_id -> community_id (its smallest member), for every node of ``edges`` (src, dst, weight)."""
    weights = cut_lineage(undirected_weights(edges))
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    assigned = cut_lineage(weights.select(F.col("u").alias("actor_id")).distinct().withColumn("label", F.col("actor_id")))
    score = None
    for level in range(levels):
        rows = weights.count()
        labels, fresh = _one_level(weights, total, rows, iterations, level, rows_per_piece)
        if score is not None and fresh <= score + TOLERANCE:
            break
        score = fresh
        labels = cut_lineage(labels)
        lift = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        assigned = cut_lineage(assigned.join(lift, "label").select("actor_id", F.col("_next").alias("label")))
        if labels.filter(F.col("node") != F.col("label")).isEmpty():
            break
        lu = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        lv = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        weights = cut_lineage(
            weights.join(lu, "u").join(lv, "v").groupBy(F.col("lu").alias("u"), F.col("lv").alias("v")).agg(F.sum("w").alias("w"))
        )
    smallest = assigned.groupBy("label").agg(F.min("actor_id").alias("community_id"))
    return assigned.join(smallest, "label").select("actor_id", "community_id")
