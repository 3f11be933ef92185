"""Accounts of stars, and what is in a cluster."""

from talewind.operators import coordination as co
from talewind.operators.components import cluster_narratives, cluster_signals, coordination_clusters
from tests.test_operators import EDGES, T0, at, no_edges


def test_accounts_of_stars(spark):
    spokes = [(f"l{i:02}", "hub", "REPOSTED", 2, 1.0) for i in range(12)] + [("m", "small", "REPOSTED", 1, 1.0), ("l00", "hub", "MENTIONED", 1, 1.0), ("hub", "hub", "REPOSTED", 9, 1.0)]
    edges = spark.createDataFrame(spokes, EDGES)
    stars = co.star_topology(edges)
    rows = {tuple(r) for r in co.star_accounts(edges, stars).collect()}
    assert rows == {("hub", f"l{i:02}", "leaf") for i in range(12)} | {("hub", "hub", "hub")}
    # Signals and their accounts have ids of one making.
    ids = {r.signal_id for r in co.as_signals(stars, "star_topology", "2024-01-01 00:00:00", ["hub"], key=["hub"]).collect()}
    found = co.as_signal_accounts(co.star_accounts(edges, stars), "star_topology", ["hub"]).collect()
    assert {r.signal_id for r in found} == ids and len(found) == 13
    assert co.star_accounts(edges.limit(0), stars.limit(0)).count() == 0


def test_contents_of_clusters(spark):
    signals = spark.createDataFrame(
        [("s1", "temporal_burst", "n", .6, T0), ("s2", "star_topology", None, .5, at(9)), ("s3", "posting_regularity", None, .9, T0),
         ("s4", "temporal_burst", "n", .7, at(3)), ("s5", "temporal_burst", "q", .9, T0), ("s6", "temporal_burst", "r", .8, T0)],
        "signal_id string, type string, narrative_id string, confidence double, detected_at timestamp",
    )
    accounts = [("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "c"), ("s3", "a"), ("s4", "a"), ("s4", "c"), ("s4", "c")]
    accounts += [(s, x) for s in ("s5", "s6") for x in "xyz"]
    accounts = spark.createDataFrame(accounts, "signal_id string, actor_id string")
    actors = spark.createDataFrame([("a", 1)], "actor_id string, follower_count long")
    clusters, members = coordination_clusters(signals, accounts, no_edges(spark), actors)
    names = {r.signal_count: r.cluster_id for r in clusters.collect()}
    found = cluster_signals(signals, accounts, members)
    # s3 has one account, so it links none.
    assert {(r.cluster_id, r.signal_id) for r in found.collect()} == {(names[3], s) for s in ("s1", "s2", "s4")} | {(names[2], s) for s in ("s5", "s6")}
    told = {(r.cluster_id, r.narrative_id): (r.signal_count, r.first_detected) for r in cluster_narratives(found).collect()}
    assert {k: n for k, (n, _) in told.items()} == {(names[3], "n"): 2, (names[2], "q"): 1, (names[2], "r"): 1}
    assert told[names[3], "n"][1] == min(r.detected_at for r in signals.filter("signal_id in ('s1', 's4')").collect())


def test_stars_write_their_edges_once_and_in_no_order(spark, sf, monkeypatch):
    from talewind.operators import graph_build
    from talewind.plans import signals as plans

    written = []
    for module in (co, graph_build, plans):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df, write=module.cut_lineage: written.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or write(df))
    accounts = plans.star_accounts(spark, sf)
    edges = [plan for columns, plan in written if "edge_type" in columns]
    assert len(edges) == 1 and "Window" not in edges[0]
    # Every repost is looked at once, for stars and their accounts alike.
    assert sum("reposts" in columns for columns, _ in written) == 1
    assert "edge_type" not in accounts._jdf.queryExecution().optimizedPlan().toString()


def test_stars_with_accounts_are_those_of_their_own(spark):
    spokes = [(f"l{i:02}", h, kind, 2, 1.0) for i in range(14) for h in ("a", "b") for kind in ("REPOSTED", "MENTIONED")]
    spokes += [(f"l{i:02}", f"l{j:02}", "REPOSTED", 1, 1.0) for i in range(3) for j in range(14)] + [("b", "l01", "MENTIONED", 1, 1.0), ("x", "a", "REPOSTED", 1, 1.0)]
    edges = spark.createDataFrame(spokes, EDGES)
    for bound in (0.1, 1.0):
        args = dict(max_connectivity=bound, min_leaves=3, min_reposts=3)
        stars, accounts = co.stars_and_accounts(edges, **args)
        assert sorted(map(tuple, stars.collect())) == sorted(map(tuple, co.star_topology(edges, **args).collect()))
        assert sorted(map(tuple, accounts.collect())) == sorted(map(tuple, co.star_accounts(edges, stars).collect()))
