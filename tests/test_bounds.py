"""Results beyond former bounds, and signals as their detectors define them."""

import datetime as dt

from pyspark.sql import functions as F

from talewind.functions.text import embedding_text
from talewind.operators import coordination as co
from talewind.operators.components import coordination_clusters
from talewind.operators.language import ngram_drift
from talewind.operators.search import first_reach_order

T0 = dt.datetime(2024, 1, 1)
EDGES = "src string, dst string, edge_type string, interaction_count long, weight double"
POSTS = "narrative_id string, actor_id string, created_at timestamp, content_id string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_a_connected_burst_hides_no_other(spark):
    dense = [("n", f"d{i}", at(i), f"d{i}") for i in range(15)]
    sparse = [("n", f"s{i}", at(5000 + i), f"s{i}") for i in range(12)]
    edges = spark.createDataFrame([(f"d{i}", f"d{j}", "REPLIED_TO", 1, 1.0) for i in range(15) for j in range(i)], EDGES)
    rows = co.temporal_burst(spark.createDataFrame(dense + sparse, POSTS), edges).collect()
    assert [(r.authors, r.density) for r in rows] == [(12, 0.0)]


def test_confidence_starts_at_the_given_minimum(spark):
    posts = spark.createDataFrame([("n", f"u{i}", at(i), f"c{i}") for i in range(4)], POSTS)
    rows = co.temporal_burst(posts, spark.createDataFrame([], EDGES), min_authors=3).collect()
    assert abs(rows[0].confidence - 0.55) < 1e-9


def test_simultaneous_posts_show_no_diversity(spark):
    def author(name, step):
        return [(f"n{0 if i > 2 else i}", name, at(i * step), f"{name}{i:03}") for i in range(43)]

    posts = spark.createDataFrame(author("once", 0) + author("spread", 60), POSTS)
    assert {r.actor_id for r in co.content_diversity(posts, 0.9).collect()} == {"spread"}


def test_one_signal_makes_no_cluster(spark):
    signals = spark.createDataFrame([("s1", "temporal_burst", "n", 0.9, T0)], "signal_id string, type string, narrative_id string, confidence double, detected_at timestamp")
    accounts = spark.createDataFrame([("s1", a) for a in "abcd"], "signal_id string, actor_id string")
    actors = spark.createDataFrame([(a, 1) for a in "abcd"], "actor_id string, follower_count long")
    assert coordination_clusters(signals, accounts, spark.createDataFrame([], EDGES), actors)[0].count() == 0


def test_many_platforms_keep_their_place(spark):
    rows = [("n", "p000", f"p{i:03}", at(i), i) for i in range(1, 120)]
    moves = spark.createDataFrame(rows, "narrative_id string, from_platform string, to_platform string, reached_at timestamp, migration_time_seconds long")
    assert first_reach_order(moves).agg(F.max("position")).first()[0] == 120


def test_long_texts_are_read_whole(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    assert spark.range(1).select(embedding_text(F.lit("t"), F.lit(text))).first()[0] == f"t {text}"


def test_drift_against_nothing_is_whole(spark):
    now = spark.createDataFrame([("g", "a b c")], "g string, ngram string")
    assert ngram_drift(now, now.limit(0), "g").first().ngram_drift == 1.0
