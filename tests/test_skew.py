"""The paths for hot keys give the same rows as the plain ones."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from talewind.functions.times import micros
from talewind.operators import graph_build as gb
from talewind.operators import identity as idn
from talewind.operators.betweenness import betweenness
from talewind.operators.components import connected_components
from talewind.operators.louvain import communities
from talewind.operators.rank import pagerank
from talewind.operators.skew import SLICE, running_sum, split_hot, top_per_group, with_last_two, with_previous
from talewind.operators.coordination import temporal_burst
from talewind.plans.tables import answers, interactions, pair_weights, posts, topic_posts
from talewind.sources.seen import drop_seen

PIECE = 40


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def hot_posts(spark, sf):
    """A third of all posts by one account."""
    p = posts(spark, sf).withColumn("us", micros("created_at"))
    return p.withColumn("actor_id", F.when(F.col("content_id") % 3 == 0, 0).otherwise(F.col("actor_id")))


def test_with_previous(spark, sf):
    p = hot_posts(spark, sf).select("actor_id", "us", "content_id", "value")
    args = (["actor_id"], "us", ["us", "content_id"], {"before": "value", "at": "us"})
    w = Window.partitionBy("actor_id").orderBy("us", "content_id")
    plain = p.withColumn("before", F.lag("value").over(w)).withColumn("at", F.lag("us").over(w))
    for width in (60_000_000, SLICE, 1 << 60):
        assert rows(with_previous(p, *args, width=width)) == rows(plain)


def test_with_last_two(spark, sf):
    p = hot_posts(spark, sf).select("actor_id", "us", "content_id", "value")
    w = Window.partitionBy("actor_id").orderBy("us", "content_id")
    plain = p.select("*", *[F.lag(c, n).over(w).alias(f"{c}{n}") for n in (1, 2) for c in ("us", "value")])
    for width in (60_000_000, SLICE, 1 << 60):
        found = with_last_two(p, ["actor_id"], "us", ["us", "content_id"], ["us", "value"], width=width)
        both = found.select(*p.columns, *[F.col(f"{s}.{c}").alias(f"{c}{n}") for n, s in ((1, "_one"), (2, "_two")) for c in ("us", "value")])
        assert rows(both) == rows(plain)


def test_running_sum(spark, sf):
    p = hot_posts(spark, sf).select("actor_id", "us", "content_id", F.round("value").cast("long").alias("value"))
    args = (["actor_id"], "us", ["us", "content_id"], {"total": "value"})
    plain = p.withColumn("total", F.sum("value").over(Window.partitionBy("actor_id").orderBy("us", "content_id").rowsBetween(Window.unboundedPreceding, 0)))
    for width in (60_000_000, SLICE, 1 << 60):
        for written in (True, False):
            assert rows(running_sum(p, *args, width=width, written=written)) == rows(plain)


def test_top_per_group_beyond_the_group_limit(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = top_per_group(df, ["k"], [F.desc("v")], 1500)
    assert out.count() == 3000 and out.agg(F.min("v")).first()[0] == 3000


def test_top_per_group_with_maps(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.create_map(F.lit("a"), "id").alias("tags"))
    assert top_per_group(df, ["k"], [F.desc("v")], 1001).count() == 2002


def test_plans_read_their_input_once(spark, sf):
    p = topic_posts(spark, sf)
    found = temporal_burst(p, pair_weights(spark, sf), 3600, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") < 10 and plan.count("Exchange") < 20


def test_split_hot_join(spark, sf):
    p = hot_posts(spark, sf).select("actor_id", "content_id")
    names = p.select("actor_id").distinct().withColumn("name", F.concat(F.lit("n"), "actor_id"))
    cut, copy = split_hot(p, "actor_id", "content_id", PIECE)
    assert cut.filter("_piece > 0").count() > 0
    joined = cut.join(copy(names, "actor_id"), ["actor_id", "_piece"]).drop("_piece")
    assert rows(joined) == rows(p.join(names, "actor_id"))


def test_first_sightings(spark, sf):
    p = hot_posts(spark, sf).select("content_id", "actor_id", "us")
    assert rows(drop_seen(p, "actor_id", "us", "content_id", 48)) == rows(drop_seen(p, "actor_id", "us", "content_id", 48, rows_per_piece=PIECE))


def test_merge_edges(spark, sf):
    e = interactions(spark, sf).withColumn("src", F.when(F.col("content_id") % 3 == 0, "c0").otherwise(F.col("src"))).withColumn("dst", F.lit("s0"))
    assert rows(gb.merge_edges(e)) == rows(gb.merge_edges(e, width=3_600_000_000))


def test_graph_algorithms(spark, sf):
    e = pair_weights(spark, sf).cache()
    assert rows(pagerank(e, rounds=5)) == rows(pagerank(e, rounds=5, rows_per_piece=20))
    thin = answers(spark, sf).filter("narrative_id < 3").select("src", "dst")
    assert rows(connected_components(thin)) == rows(connected_components(thin, rows_per_piece=3))
    assert rows(betweenness(thin, directed=False)) == rows(betweenness(thin, directed=False, rows_per_piece=5, sources_per_batch=4))
    small = thin.withColumn("weight", F.lit(1.0))
    assert rows(communities(small)) == rows(communities(small, rows_per_piece=5))


def test_crowded_names_lose_no_link(spark):
    """400 accounts of one name: the links between groups stand for exactly those of all pairs."""
    hours, topics = ([9, 10], [10, 11], [1]), (["x"], ["x", "y"], ["z"])
    people = [(f"{p}{i:03}", p, "Anonymous" if i % 2 else "anonymous", None, hours[i % 3], topics[i % 9 // 3]) for p in ("reddit", "gab") for i in range(200)]
    people += [("t1", "twitter", None, None, [1], ["x"]), ("t2", "twitter", "", None, [1], ["x"])]
    actors = spark.createDataFrame(people, "actor_id string, primary_platform string, username string, bio string, active_hours array<int>, primary_topics array<string>")
    shared = spark.createDataFrame([("gab003", "h"), ("reddit004", "h"), ("reddit007", "h"), ("gab003", "k"), ("reddit007", "k")], "actor_id string, hash string")
    for hashes in (None, shared):
        links, groups = idn.linked_accounts(actors, hashes)
        every = idn.score_identity(idn.candidates_by_username(actors), actors, hashes)
        found = [(r.actor_a, r.actor_b, r.confidence) for r in idn.expanded(links, groups).select("actor_a", "actor_b", "confidence").collect()]
        want = [(r.actor_a, r.actor_b, r.confidence) for r in every.collect()]
        assert sorted(found) == sorted(want) and 0 < len(want) < 40_000
        sizes = links.select("accounts_a", "accounts_b").collect()
        assert len(sizes) < 500 and sum(r.accounts_a * r.accounts_b for r in sizes) == len(want)
    assert groups.filter("actor_id in ('t1', 't2')").isEmpty()


def test_names_of_one_platform_are_in_no_group(spark):
    people = [("a", "gab", "Ann", None, [1], ["x"]), ("b", "reddit", "ann", None, [1], ["x"]), ("c", "gab", "bob", None, [1], ["x"]), ("d", "gab", "BOB", None, [1], ["x"])]
    actors = spark.createDataFrame(people, "actor_id string, primary_platform string, username string, bio string, active_hours array<int>, primary_topics array<string>")
    hashes = spark.createDataFrame([(p, h) for p in "abcd" for h in ("h", "k", "h")], "actor_id string, hash string")
    links, groups = idn.linked_accounts(actors, hashes)
    assert [(r.actor_a, r.actor_b) for r in links.collect()] == [("a", "b")]
    assert sorted(r.actor_id for r in groups.collect()) == ["a", "b"]
