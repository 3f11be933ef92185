"""Operators on hand-made rows with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talewind.operators import coordination as co
from talewind.operators import engagement as en
from talewind.operators import graph_build as gb
from talewind.operators import identity as idn
from talewind.operators import images as im
from talewind.operators import language as la
from talewind.operators import metrics as me
from talewind.operators import migration as mi
from talewind.operators import predict as pr
from talewind.operators import velocity as ve
from talewind.operators.components import coordination_clusters
from talewind.operators.stages import Pipeline

T0 = dt.datetime(2024, 1, 1)
EDGES = "src string, dst string, edge_type string, interaction_count long, weight double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def burst_posts(spark, n, step=5):
    return spark.createDataFrame([("n1", f"u{i}", at(i * step)) for i in range(n)], "narrative_id string, actor_id string, created_at timestamp")


def no_edges(spark):
    return spark.createDataFrame([], EDGES)


def test_burst_needs_ten_unconnected_authors(spark):
    assert co.temporal_burst(burst_posts(spark, 3), no_edges(spark)).count() == 0
    r = co.temporal_burst(burst_posts(spark, 15), no_edges(spark)).collect()
    assert len(r) == 1 and r[0].authors == 15 and abs(r[0].confidence - .75) < 1e-9 and r[0].density == 0
    linked = spark.createDataFrame([(f"u{i}", f"u{j}", "REPLIED_TO", 1, 1.0) for i in range(15) for j in range(i)], EDGES)
    assert co.temporal_burst(burst_posts(spark, 15), linked).count() == 0
    # At 20 s apart only seven authors ever share two minutes.
    assert co.temporal_burst(burst_posts(spark, 15, 20), no_edges(spark)).count() == 0


def test_density(spark):
    members = spark.createDataFrame([("s", a) for a in "abc"] + [("one", "a")], "k string, actor_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "x")], "src string, dst string")
    got = {r.k: (r.linked_pairs, r.density) for r in co.connection_density(members, edges, ["k"]).collect()}
    assert got == {"s": (3, 1.0), "one": (0, 0.0)}


def test_regular_poster(spark):
    rows = [("clock", f"{i:03}", at(60 * i), "n") for i in range(30)] + [("new", "x", at(0), "n")]
    posts = spark.createDataFrame(rows, "actor_id string, content_id string, created_at timestamp, narrative_id string")
    r = co.posting_regularity(posts).collect()
    assert [(x.actor_id, x.gaps, x.cv, x.mean_gap) for x in r] == [("clock", 28, 0.0, 60.0)] and abs(r[0].confidence - .9) < 1e-9


def test_star(spark):
    spokes = [(f"l{i:02}", "hub", "REPOSTED", 2, 1.0) for i in range(12)] + [(f"m{i:02}", "small", "REPOSTED", 1, 1.0) for i in range(12)]
    r = co.star_topology(spark.createDataFrame(spokes, EDGES)).collect()
    assert [(x.hub, x.leaf_count, x.repost_count) for x in r] == [("hub", 12, 24)] and abs(r[0].confidence - .64) < 1e-9


def test_clusters(spark):
    signals = spark.createDataFrame(
        [("s1", "temporal_burst", "n", .6, T0), ("s2", "star_topology", None, .5, at(9)), ("s3", "posting_regularity", None, .9, T0)],
        "signal_id string, type string, narrative_id string, confidence double, detected_at timestamp",
    )
    accounts = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "c"), ("s3", "z")], "signal_id string, actor_id string")
    actors = spark.createDataFrame([("a", 20000), ("b", 30000), ("c", None)], "actor_id string, follower_count long")
    found, members = coordination_clusters(signals, accounts, no_edges(spark), actors)
    r = found.collect()
    assert len(r) == 1 and r[0].confidence == .8 and r[0].severity == "high" and r[0].estimated_reach == 50000 and r[0].signal_count == 2
    assert {m.actor_id for m in members.collect()} == {"a", "b", "c"}
    talk = spark.createDataFrame([("a", "b", "REPLIED_TO", 1, 1.0)], EDGES)
    assert coordination_clusters(signals, accounts, talk, actors)[0].count() == 0


def test_edges_of_posts(spark):
    cols = "content_id string, platform string, content_type string, created_at timestamp, actor_id string, parent_id string, root_id string, mentions array<string>, forwarded_from string"
    posts = spark.createDataFrame(
        [("1", "x", "post", at(0), "A", None, "1", ["bob", "eve"], None), ("2", "x", "reply", at(10), "B", "1", "1", [], None), ("3", "x", "reply", at(20), "C", "2", "1", [], None),
         ("4", "x", "reply", at(30), "A", "1", "1", [], None), ("5", "x", "repost", at(40), "D", "1", None, [], "chan"), ("6", "y", "reply", at(50), "E", "1", None, [], None),
         ("7", "x", "reply", at(9 * 86400), "F", "1", "1", [], None)], cols)
    got = {(r.src, r.dst, r.edge_type) for r in gb.interactions(posts).collect()}
    assert {(s, d, t) for s, d, t in got if t in ("REPLIED_TO", "REPOSTED")} == {("B", "A", "REPLIED_TO"), ("C", "B", "REPLIED_TO"), ("C", "A", "REPLIED_TO"), ("D", "A", "REPOSTED")}
    assert sum(t == "MENTIONED" for *_, t in got) == 2 and sum(t == "FORWARDED_FROM" for *_, t in got) == 1
    assert gb.stub_actors(posts).count() == 3


def test_edge_weight_decays_by_whole_days(spark):
    day = 86400
    events = spark.createDataFrame([("a", "b", "X", at(s), "p", None, str(i)) for i, s in enumerate((0, 10, day + 20, 4 * day))] + [("a", "a", "X", at(0), "p", None, "9")],
                                   "src string, dst string, edge_type string, ts timestamp, platform string, narrative_id string, content_id string")
    r = gb.merge_edges(events).collect()
    assert len(r) == 1 and abs(r[0].weight - (1 + 1 + .5 + 1 / 3)) < 1e-9 and r[0].interaction_count == 4


def test_velocity_and_anomaly(spark):
    rows = [("one", at(0), 1, 1), ("a", at(0), 0, 0), ("a", at(3600), 600, 1), ("a", at(7200), 3100, 3), ("z", at(0), 1, 0), ("z", at(0), 2, 0)]
    v = ve.engagement_velocity(spark.createDataFrame(rows, "content_id string, ts timestamp, likes long, replies long"))
    assert [(r.content_id, r.likes_per_hour, r.replies_per_hour, r.acceleration) for r in v.orderBy("content_id", "ts").collect()] == [("a", 600.0, 1.0, None), ("a", 2500.0, 2.0, 1900.0)]
    assert [r.severity for r in ve.velocity_anomaly(v).orderBy("ts").collect()] == ["medium", "high"]


def test_edit_war_needs_a_revert_after_the_tenth_edit(spark):
    def edits(reverts):
        return spark.createDataFrame([("p", i, at(i), i in reverts) for i in range(12)], "title string, edit_id long, ts timestamp, is_revert boolean")
    assert ve.edit_wars(edits({1, 2, 3})).count() == 0
    assert [r.edit_id for r in ve.edit_wars(edits({1, 2, 10})).collect()] == [10]


def test_language_needs_fifty_texts_and_sees_drift(spark):
    text = lambda g, n, t: [(g, t)] * n
    schema = "g string, text string"
    old = spark.createDataFrame(text("a", 50, "one two three") + text("b", 49, "x y z") + text("c", 50, "p q r"), schema)
    new = spark.createDataFrame(text("a", 50, "one two three") + text("b", 50, "x y z") + text("c", 50, "k l m n"), schema)
    args = []
    for df in (new, old):
        args.append(la.language_profile(df, "g"))
    args += [la.top_ngrams(new, ["g"]), la.top_ngrams(old, ["g"])]
    assert {r.g for r in args[1].collect()} == {"a", "c"}
    r = la.language_shift(*args, "g").collect()
    assert [(x.g, x.severity, x.ngram_drift, x.new_ngrams, x.avg_length_change) for x in r] == [("c", "high", 1.0, ["k l", "l m", "m n"], 1.0)]
    assert {r.g for r in la.updated_baseline(args[0], args[1], "g").collect()} == {"a", "b", "c"}


def test_engagement_shift(spark):
    def posts(reply):
        return spark.createDataFrame([("g", f"u{i % 4}", "a b", i < reply, False, i % 24) for i in range(24)], "g string, author_id string, text string, is_reply boolean, is_repost boolean, hour int")
    now, then = en.engagement_profile(posts(18), "g"), en.engagement_profile(posts(6), "g")
    r = en.engagement_shift(now, then, "g").collect()
    assert len(r) == 1 and r[0].shift_count == 2 and r[0].severity == "medium"
    assert en.engagement_profile(posts(1).limit(19), "g").count() == 0


def test_migrations(spark):
    posts = spark.createDataFrame([("n", "reddit", at(0)), ("n", "twitter", at(90)), ("n", "reddit", at(100)), ("m", "web", at(0))], "narrative_id string, platform string, created_at timestamp")
    line = mi.platform_timeline(posts)
    found = mi.detect_migrations(line)
    assert [(r.from_platform, r.to_platform, r.migration_time_seconds) for r in found.collect()] == [("reddit", "twitter", 90)]
    known = mi.known_after(line.limit(0), found)
    assert mi.detect_migrations(line, known).count() == 0


def test_counters_add_amounts_and_roll_up(spark):
    e = spark.createDataFrame([("c", {"x": "1"}, "counter", 2.0, at(0)), ("c", {"x": "1"}, "counter", 3.0, at(61)), ("c", {}, "counter", 5.0, at(3700)), ("g", {}, "gauge", 9.0, at(0))],
                              "name string, tags map<string,string>, kind string, value double, ts timestamp")
    got = {(r.name, tuple(r.tags.items()), r.grain, r.total) for r in me.counter_rollup(e).collect()}
    assert ("c", (("x", "1"),), "total", 5.0) in got and ("c", (), "hour", 5.0) in got and sum(g[2] == "minute" for g in got) == 3
    total = {(r.grain, r.total) for r in me.counter_rollup(e, keys=["name"]).collect()}
    assert ("total", 10.0) in total and not any(t == ("total", 19.0) for t in total)


ACTORS = "actor_id string, primary_platform string, username string, bio string, active_hours array<int>, primary_topics array<string>"


def test_identity(spark):
    hours = list(range(9, 15))
    actors = spark.createDataFrame(
        [("a", "twitter", "Ann", "also on reddit.com/u/ann", hours, ["x"]), ("b", "reddit", "ann", None, hours, ["x"]), ("c", "twitter", "ann", None, hours, ["x"]), ("d", "gab", "ann", None, None, None)], ACTORS)
    cand = idn.candidate_pairs(idn.candidates_by_username(actors), idn.candidates_by_bio(actors))
    assert ("a", "c") not in {tuple(r) for r in cand.collect()}
    links = {(r.actor_a, r.actor_b): r.confidence for r in idn.score_identity(cand, actors).collect()}
    assert links[("a", "b")] > .9 and ("a", "d") not in links and set(links) == {("a", "b"), ("b", "c")}
    linked = idn.score_identity(cand, actors)
    # "ann" in the biography of a also names d, and that pair stays a candidate.
    assert [tuple(r) for r in idn.candidates_by_bio(actors, linked).collect()] == [("a", "d")]


def narratives(spark, rows):
    base = dict(keywords=["k"], category="c", velocity_curve=[1.0, 2.0, 1.0], platforms=["reddit"], origin_platform="reddit", coordination_score=0.0, duration_hours=10.0, peak_velocity=1.0, summary="s", outcome="o")
    schema = ("narrative_id string, status string, keywords array<string>, category string, velocity_curve array<double>, platforms array<string>, origin_platform string, coordination_score double, "
              "duration_hours double, peak_velocity double, summary string, outcome string")
    return spark.createDataFrame([(i, s, *({**base, **more}[k] for k in base)) for i, s, more in rows], schema)


def test_predictions(spark):
    state = narratives(spark, [("now", "growing", dict(coordination_score=.3)), ("h1", "dead", dict(duration_hours=48.0, platforms=["reddit", "twitter"], coordination_score=.9)),
                               ("h2", "dormant", dict(duration_hours=72.0, platforms=["reddit", "twitter", "telegram"]))] + [(f"x{i}", "dead", dict(keywords=["z"], platforms=["q"], origin_platform="q", category="y")) for i in range(18)])
    history = pr.historical_narratives(state)
    similar = pr.narrative_similarity(pr.active_narratives(state), history)
    m = pr.pattern_matches(similar, history)
    assert {r.matched_narrative_id for r in m.collect()} == {"h1", "h2"}
    assert pr.predict_peak(m).first().predicted_timeframe_hours == 24
    p = pr.predict_migration(m, state).first()
    assert p.target_platform == "twitter" and p.probability == 1 and p.confidence == .85
    assert abs(pr.predict_coordination(m, state).first().probability - .42) < 1e-9
    assert pr.predictions(m, state).count() == 3
    assert pr.historical_narratives(state, minimum=21).count() == 0
    with pytest.raises(ValueError):
        pr.narrative_similarity(state, state, above=.4)


def test_images(spark):
    rows = [("a", "x", 0), ("b", "y", 0), ("c", "x", 0), ("d", "z", 1023), ("e", "z", 2047)]
    h = spark.createDataFrame(rows, "content_id string, platform string, hash long")
    assert {(r.content_id, r.matches) for r in im.image_hash_matches(h).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert {r.content_id for r in im.image_match_members(h, "a").collect()} == {"b"}
    assert {(r.hash_a, r.hash_b, r.distance) for r in im.image_near_matches(h).collect()} == {(0, 1023, 10), (1023, 2047, 1)}


def test_pipeline_runs_steps_in_order(spark):
    out = Pipeline.of([lambda d: d.withColumn("x", F.col("id") + 1)]).add("twice", lambda d: d.withColumn("x", F.col("x") * 2)).run(spark.range(1))
    assert out.first().x == 2


def test_star_topology_makes_its_edges_once(spark):
    from talewind.operators.coordination import star_topology

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    kind = "src string, dst string, edge_type string, interaction_count long"
    rows = [(f"l{i}", "hub", "REPOSTED", 9) for i in range(40)] + [("l1", "l2", "REPLIED_TO", 1), ("l3", "other", "REPLIED_TO", 1)]
    got = star_topology(spark.createDataFrame(rows, kind).mapInPandas(count, kind)).collect()
    # Of the two further edges one joins two leaves; an edge counts twice.
    assert [(r.hub, r.leaf_count, r.leaf_links) for r in got] == [("hub", 40, 2)]
    assert made.value == len(rows)


def test_hashes_of_pairs_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    rows = [(a, h) for a, own in (("a", "xyz"), ("b", "yzw"), ("c", "x"), ("d", "q")) for h in own]
    hashes = spark.createDataFrame(rows, "actor_id string, hash string").withColumn("hash", F.udf(note)("hash"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "actor_a string, actor_b string")
    assert {tuple(r) for r in idn.content_fingerprints(pairs, hashes).collect()} == {("a", "b", 2), ("a", "c", 1)}
    assert seen.value <= len(rows)
