"""Tables that loops keep where they lie: a round moves the small side only, whatever Spark would broadcast."""

import pytest

from talewind.operators import louvain, rank
from talewind.operators.skew import dealt_once
from talewind.plans.tables import pair_weights


def outside(plan):
    """The lines of a plan that are not part of how a cached table was made."""
    kept, inner = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        inner = None if inner is not None and depth <= inner else inner
        if inner is None:
            kept.append(line)
            inner = depth if "InMemoryTableScan" in line else None
    return "\n".join(kept)


@pytest.fixture
def plans(spark, monkeypatch):
    """Physical plans of the tables that a loop writes, with nothing broadcast by size."""
    seen, held = [], {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {x: spark.conf.get(x) for x in held}
    for x in held:
        spark.conf.set(x, held[x])
    for module in (rank, louvain):
        def written(df, write=module.cut_lineage):
            seen.append(outside(df._jdf.queryExecution().executedPlan().toString()))
            return write(df)
        monkeypatch.setattr(module, "cut_lineage", written)
    yield seen
    for x in held:
        spark.conf.set(x, before[x])


@pytest.mark.parametrize("piece", [None, 20])
def test_big_side_is_not_moved(spark, sf, plans, piece):
    e = pair_weights(spark, sf).select("src", "dst", "weight").localCheckpoint()
    other = e.groupBy("src").agg({"weight": "sum"})
    kept, met = dealt_once(e, "src", "dst", piece, known_rows=e.count(), beside=e.groupBy("src").agg({"weight": "max"}))
    plan = met(other)._jdf.queryExecution().executedPlan().toString()
    # Lines from the cached table up to the join, which is the first line that names a hash join.
    above = plan[: plan.index("InMemoryTableScan")]
    assert "SortMergeJoin" not in plan and "Exchange" not in above[above.index("ShuffledHashJoin"):]
    # As many parts as cores, whatever the number of shuffle partitions.
    assert met(other).count() == e.count() and met(other).rdd.getNumPartitions() == kept.rdd.getNumPartitions() == 8
    kept.unpersist()


def test_rounds_of_pagerank_move_ranks_only(spark, sf, plans):
    rank.pagerank(pair_weights(spark, sf), rounds=1)
    # On the way from the links to the result only the sums are moved.
    above = plans[-1][: plans[-1].index("InMemoryTableScan")]
    assert above.count("Exchange hashpartitioning") == 1 and above.index("Exchange") < above.index("ShuffledHashJoin")
    rank.pagerank(pair_weights(spark, sf), rounds=5)
    # Old ranks are read once, so plans grow with the rounds and don't double.
    assert plans[-1].count("Union") <= 9


def test_iterations_of_communities_move_weights_once(spark, sf, plans):
    e = pair_weights(spark, sf).filter("src < 40 and dst < 40")
    louvain.communities(e, levels=1, iterations=2)
    steps = [p for p in plans if "InMemoryTableScan" in p]
    assert len(steps) == 3
    for p in steps:
        assert p.count("InMemoryTableScan") == 1
        lines = p[: p.index("InMemoryTableScan")].splitlines()
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
        # Exchanges on the way from the weights to the result: by node and label, and the choice of each node.
        way, least = [], 1 << 30
        for x, d in zip(reversed(lines), reversed(depth)):
            if d < least:
                way, least = [*way, x], d
        moved = [x for x in way if "Exchange" in x]
        assert len(moved) == 2 and "part#" in moved[0] and "part#" not in moved[1]
