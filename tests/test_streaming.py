"""Stream = batch: the same rows through a file source and through the batch operators."""

import pytest
from pyspark.sql import functions as F

from talewind.operators import coordination as co
from talewind.operators import graph_build as gb
from talewind.operators import metrics as me
from talewind.operators import migration as mi
from talewind.operators import velocity as ve
from talewind.plans.graph import thread_posts
from talewind.plans.tables import posts
from talewind.sources.generate import generate_content
from talewind.sources.store import append_if_absent
from talewind.streaming import jobs, state


def as_stream(df, path, ts, files=3):
    """Rows written as a few files in event-time order, read back as a stream of one file per batch."""
    spark = df.sparkSession
    ordered = df.orderBy(ts).collect()
    size = max(1, -(-len(ordered) // files))
    for i in range(0, len(ordered), size):
        spark.createDataFrame(ordered[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark, sf):
    return posts(spark, sf).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_counter_windows(spark, events, tmp_path):
    df = events.select(F.col("platform").alias("name"), "value", F.col("created_at").alias("ts"))
    out = run(jobs.counter_windows(as_stream(df, str(tmp_path), "ts"), "hour"), "counters", "complete")
    batch = me.counter_rollup(df, keys=["name"]).filter("grain = 'hour'")
    got = rows(out.select(F.unix_timestamp("start").alias("b"), "name", F.round("total", 6)), "b", "name", "round(total, 6)")
    assert got == rows(batch.select(F.col("bucket").alias("b"), "name", F.round("total", 6)), "b", "name", "round(total, 6)")


def test_platform_timeline(spark, events, tmp_path):
    out = run(jobs.platform_timeline(as_stream(events, str(tmp_path), "created_at")), "timeline", "complete")
    cols = ["narrative_id", "platform", "first_seen", "content_count"]
    assert rows(out, *cols) == rows(mi.platform_timeline(events), *cols)


def test_snapshots_append_only_final_buckets(spark, events, tmp_path):
    out = run(jobs.narrative_snapshots(as_stream(events, str(tmp_path), "created_at"), 86400), "snapshots")
    batch = mi.narrative_snapshots(events.withColumnRenamed("value", "sentiment"), 86400)
    cols = ["bucket", "narrative_id", "content_count", "actor_count"]
    got, full = rows(out, *cols), rows(batch, *cols)
    last = max(r[0] for r in full)
    assert set(got) >= {r for r in full if r[0] < last - 86400}
    assert set(got) <= set(full)


def test_first_sightings_never_repeat_early(spark, events, tmp_path):
    df = events.select("actor_id", "created_at")
    out = run(jobs.first_sightings(as_stream(df, str(tmp_path), "created_at"), "actor_id", "created_at"), "seen").collect()
    assert {r.actor_id for r in out} == {r.actor_id for r in df.distinct().collect()}
    by_key = {}
    for r in out:
        by_key.setdefault(r.actor_id, []).append(r.created_at.timestamp())
    assert all(b - a > 48 * 3600 for times in by_key.values() for a, b in zip(sorted(times), sorted(times)[1:]))


def test_burst_windows(spark, events, tmp_path):
    df = events.drop("narrative_id").withColumnRenamed("topic", "narrative_id")
    out = run(jobs.burst_windows(as_stream(df, str(tmp_path), "created_at"), 3600, 600, 3), "bursts").collect()
    batch = co.burst_windows(df, 3600, 3).collect()
    exact = {(r.narrative_id, r.authors, r.window_end) for r in batch}
    assert out and exact
    # Every burst seen in slid windows lies within a burst of the exact sweep.
    for r in out:
        end = r.window_end.timestamp() * 1e6
        assert any(n == r.narrative_id and end - 3600e6 <= at < end and k >= r.authors for n, k, at in exact)


def test_parent_authors(spark, sf, tmp_path):
    df = thread_posts(spark, sf).select("content_id", "platform", "created_at", "actor_id", "parent_id")
    stream = as_stream(df, str(tmp_path), "created_at")
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = run(jobs.parent_authors(stream, again), "parents")
    cols = ["content_id", "actor_id", "target"]
    assert rows(out, *cols) == rows(gb.resolve_parent_author(df), *cols)


def test_edit_wars(spark, events, tmp_path):
    df = events.select(F.col("platform").alias("title"), F.col("content_id").alias("edit_id"), F.col("created_at").alias("ts"), (F.col("value") > 20).alias("is_revert"))
    out = run(jobs.edit_wars(as_stream(df, str(tmp_path), "ts"), min_edits=2, min_reverts=1), "wars", "complete")
    batch = ve.edit_wars(df, 2, 1).select("title", "hour").distinct()
    assert set(rows(batch, "title", "hour")) <= set(rows(out, "title", "hour"))


def test_posting_habits_match_batch_for_the_latest_post(spark, events, tmp_path):
    df = events.select("actor_id", "content_id", "created_at", F.col("topic").alias("narrative_id"))
    out = run(state.posting_habits(as_stream(df, str(tmp_path), "created_at"), max_cv=0.95, max_mean=1e9, max_entropy=0.97), "habits")
    latest = df.groupBy(F.col("actor_id").cast("string").alias("actor_id")).agg(F.max_by(F.col("content_id").cast("string"), F.struct("created_at", "content_id")).alias("content_id"))
    final = out.join(latest, ["actor_id", "content_id"])
    batch = co.posting_regularity(df, 0.95, 1e9).select(F.col("actor_id").cast("string"), "cv", "gaps")
    assert rows(final.filter("type = 'posting_regularity'"), "actor_id", "measure", "sample") == rows(batch, "actor_id", "cv", "gaps")
    diverse = co.content_diversity(df, 0.97).select(F.col("actor_id").cast("string"), "entropy", "posts")
    assert rows(final.filter("type <> 'posting_regularity'"), "actor_id", "measure", "sample") == rows(diverse, "actor_id", "entropy", "posts")


def test_engagement_velocity(spark, events, tmp_path):
    df = events.select(F.col("actor_id").alias("content_id"), F.col("created_at").alias("ts"), F.col("value").alias("likes"), F.col("narrative_id").alias("replies"))
    out = run(state.engagement_velocity(as_stream(df, str(tmp_path), "ts")), "velocity")
    cols = ["content_id", "likes_per_hour", "replies_per_hour"]

    def rounded(d):
        return rows(d.select(F.col("content_id").cast("string").alias("content_id"), *[F.round(c, 6).alias(c) for c in cols[1:]]), *cols)

    assert rounded(out) == rounded(ve.engagement_velocity(df))


def test_append_and_actor_steps_are_idempotent(spark, tmp_path):
    content = generate_content(spark, 60, seed=3, people=20)
    again = generate_content(spark, 80, seed=3, people=20)
    path, actors = str(tmp_path / "content"), str(tmp_path / "actors")
    step = jobs.append_content(path)
    for batch, n in ((content, 0), (content, 0), (again, 1)):
        step(batch, n)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("platform", "platform_content_id").distinct().count() == again.select("platform", "platform_content_id").distinct().count()
    update = jobs.update_actors(actors)
    rest = append_if_absent(again, content)
    update(content, 0)
    update(rest, 1)
    update(rest, 1)
    merged = spark.read.parquet(f"{actors}/version=1")
    full = gb.build_actors(again)
    cols = ["actor_id", "content_count", "follower_count", "username", "first_seen", "last_seen"]
    assert rows(merged, *cols) == rows(full, *cols)


def test_image_match_step(spark, tmp_path):
    step = jobs.image_matches(str(tmp_path / "h"), str(tmp_path / "m"))
    step(spark.createDataFrame([("a", "x", 5), ("b", "x", 6)], "content_id string, platform string, hash long"), 0)
    step(spark.createDataFrame([("c", "y", 5)], "content_id string, platform string, hash long"), 1)
    found = spark.read.parquet(str(tmp_path / "m"))
    assert rows(found, "content_id", "matches") == [("c", 1)]
