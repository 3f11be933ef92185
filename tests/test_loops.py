"""What shared steps no longer do: count pairs at every window, read posts for every figure."""

import pytest
from talewind.operators import coordination as co
from talewind.operators import graph_build as gb
from talewind.plans.forecasts import narrative_state
from talewind.plans.tables import interactions, pair_weights, topic_posts


def test_sparse_bursts_need_no_pairs_of_spells(spark, sf, monkeypatch):
    p, e = topic_posts(spark, sf), pair_weights(spark, sf)
    monkeypatch.setattr(co, "WINDOWS_TRIED", 0, raising=False)
    swept = sorted(map(tuple, co.temporal_burst(p, e, 3600, 3, 2.0).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(co, "linked_spells", lambda *_: pytest.fail("all windows were looked at"))
    found = sorted(map(tuple, co.temporal_burst(p, e, 3600, 3, 2.0).collect()))
    assert found == swept and found


def test_state_reads_posts_once(spark, sf):
    plan = narrative_state(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 0 and plan.count("Exchange") == 0


def test_counted_edges(spark, sf):
    e, columns = interactions(spark, sf), ["src", "dst", "edge_type", "interaction_count"]
    merged, counted = gb.merge_edges(e).select(columns), gb.counted_edges(e)
    assert counted.columns == columns and merged.count() == counted.count() and merged.exceptAll(counted).isEmpty()
