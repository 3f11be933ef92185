"""Iterative operators against brute force on small graphs."""

import itertools
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from talewind.operators.betweenness import betweenness
from talewind.operators.components import connected_components
from talewind.operators.louvain import communities, modularity, undirected_weights
from talewind.operators.paths import shortest_path
from talewind.operators.rank import pagerank

EDGES = "src string, dst string, edge_type string, weight double"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "REPLIED_TO", 1.0) for a, b in pairs], EDGES)


def cliques(spark):
    left, right = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    return frame(spark, [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("a0", "b0")])


def test_components(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x1", "x2"), ("hub", "x1")] + [("star", f"leaf{i}") for i in range(20)]
    got = {r.actor_id: r.component for r in connected_components(frame(spark, pairs)).collect()}
    assert got["n060"] == "n000" and got["x2"] == "hub" and got["leaf7"] == "leaf0" and len(got) == 61 + 3 + 21


def test_communities_of_two_cliques(spark):
    e = cliques(spark)
    found = communities(e)
    got = {r.actor_id: r.community_id for r in found.collect()}
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"}
    score = modularity(undirected_weights(e), found.select(F.col("actor_id").alias("node"), F.col("community_id").alias("label")))
    assert abs(score - (20 / 21 - 2 * (21 / 42) ** 2)) < 1e-9


def brute_betweenness(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, defaultdict(float), []
        paths[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


def test_betweenness(spark):
    rng = np.random.default_rng(4)
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")] + [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (20, 2)) if a != b]
    got = {r.actor_id: r.betweenness for r in betweenness(frame(spark, pairs), directed=False, sources_per_batch=5).collect()}
    expected = brute_betweenness(pairs)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_pagerank_equals_matrix_form(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 10, (40, 2)) if a != b})
    e = spark.createDataFrame([(str(a), str(b), "X", float(a + b + 1)) for a, b in pairs], EDGES)
    got = {int(r.actor_id): r.pagerank for r in pagerank(e, rounds=50, tolerance=0.0).collect()}
    w = np.zeros((10, 10))
    for a, b in pairs:
        w[a, b] = a + b + 1
    out = w.sum(1, keepdims=True)
    w = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    rank = np.full(10, .15)
    for _ in range(50):
        rank = .15 + .85 * rank @ w
    rank = rank / sum(rank[i] for i in got)
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in got) and abs(sum(got.values()) - 1) < 1e-9


def test_shortest_path(spark):
    e = frame(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("a", "x"), ("y", "z")])
    path = sorted((r.step, r.actor_id) for r in shortest_path(e, "a", "d").collect())
    assert path == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert shortest_path(e, "a", "z").count() == 0 and shortest_path(e, "a", "d", max_hops=2).count() == 0
    assert [r.actor_id for r in shortest_path(e, "a", "a").collect()] == ["a"]


def test_betweenness_adds_up_links_in_tasks(spark, monkeypatch):
    from talewind.operators import betweenness as module

    rng = np.random.default_rng(7)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, size=(40, 2)).tolist() if a != b})
    for name, value in {"LINKS_PER_TASK": 9, "SOURCES_PER_TASK": 4, "_LINKS_AT_ONCE": 3}.items():
        monkeypatch.setattr(module, name, value)
    got = {r.actor_id: r.betweenness for r in betweenness(frame(spark, pairs), directed=False).collect()}
    expected = brute_betweenness(pairs)
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_betweenness_makes_no_rows_of_source_and_node(spark, monkeypatch):
    from talewind.operators import betweenness as module

    monkeypatch.setattr(module, "_step", None)
    rng = np.random.default_rng(8)
    # A dense part, a long ring, and a node that nothing leads to.
    pairs = sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 20, size=(150, 2)).tolist() if a != b})
    pairs += [(f"r{i:02}", f"r{(i + 1) % 30:02}") for i in range(30)] + [("n00", "r00"), ("lone", "n01")]
    expected = brute_betweenness(pairs)
    for cells, steps, worth in ((1 << 19, 1 << 17, 1 << 30), (120, 7, 500)):
        for name, value in {"_CELLS": cells, "_STEPS": steps, "STEPS_PER_TASK": worth}.items():
            monkeypatch.setattr(module, name, value)
        got = {r.actor_id: r.betweenness for r in betweenness(frame(spark, pairs), directed=False).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_betweenness_of_more_links_than_a_task_holds_is_bounded(spark, monkeypatch):
    from talewind.operators import betweenness as module

    sizes = []
    whole = module._dependencies
    monkeypatch.setattr(module, "_dependencies", lambda starts, forward, backward, groups: sizes.append(groups) or whole(starts, forward, backward, groups))
    for name, value in {"LINKS_HELD": 5, "CELLS_PER_TASK": 16}.items():
        monkeypatch.setattr(module, name, value)
    pairs = [(f"n{i}", f"n{(i * 3 + 1) % 8}") for i in range(8) if i != (i * 3 + 1) % 8]
    got = {r.actor_id: r.betweenness for r in betweenness(frame(spark, pairs), directed=False).collect()}
    assert got == brute_betweenness(pairs) and sizes == [-(-len(got) // (16 // len(got)))]


def test_path_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    edges = frame(spark, pairs).mapInPandas(count, EDGES)
    assert shortest_path(edges, "a", "e").count() == 5
    assert made.value == len(pairs)
