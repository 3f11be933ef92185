"""Streaming forms of the operators: streaming DataFrame in, streaming DataFrame (or a foreachBatch step) out.

The caller picks source, trigger and sink. Event time rules: a watermark says how late a row may be; later rows are
dropped by Spark and counted in the query progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.scores import severity_of
from talewind.operators.coordination import BURST_AUTHORS, BURST_SECONDS
from talewind.operators.graph_build import LOOKBACK_DAYS, build_actors, merge_actors
from talewind.operators.images import image_hash_matches
from talewind.operators.metrics import GRAINS
from talewind.operators.velocity import WAR_EDITS, WAR_REVERTS
from talewind.sources.store import append_if_absent, write_content

LATE = "5 minutes"


def first_sightings(stream: DataFrame, key: str, ts: str, ttl: str = "48 hours") -> DataFrame:
    """First row per key within the life time. The batch form restarts the life time at every emitted row; here it is
    the watermark delay, so a key may return a little later than its life time, never earlier."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def counter_windows(events: DataFrame, grain: str = "minute", late: str = LATE) -> DataFrame:
    """Tumbling counters per name: start, name, total. Use output mode update (running) or append (final)."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", f"{GRAINS[grain]} seconds"), "name")
    return windowed.agg(F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "name", "total")


def platform_timeline(posts: DataFrame) -> DataFrame:
    """Running first time and count per (narrative, platform); output mode update or complete."""
    return posts.groupBy("narrative_id", "platform").agg(F.min("created_at").alias("first_seen"), F.count("*").alias("content_count"))


def narrative_snapshots(posts: DataFrame, grain_seconds: int = 3600, late: str = LATE) -> DataFrame:
    """Posts and distinct actors per narrative and bucket (append mode): a bucket's actors are grouped before they are
    counted, so the state holds rows and no sets."""
    bucket = F.window("created_at", f"{grain_seconds} seconds")
    per_actor = posts.withWatermark("created_at", late).groupBy(bucket, "narrative_id", "actor_id").agg(F.count("*").alias("n"))
    counted = per_actor.groupBy("window", "narrative_id").agg(F.sum("n").alias("content_count"), F.count("*").alias("actor_count"))
    return counted.select(F.unix_timestamp("window.start").alias("bucket"), "narrative_id", "content_count", "actor_count")


def burst_windows(
    posts: DataFrame, window_seconds: int = BURST_SECONDS, slide_seconds: int = 10, min_authors: int = BURST_AUTHORS, late: str = LATE
) -> DataFrame:
    """Sliding windows with at least ``min_authors`` distinct authors per narrative (append mode)."""
    sliding = F.window("created_at", f"{window_seconds} seconds", f"{slide_seconds} seconds")
    authors = posts.withWatermark("created_at", late).groupBy(sliding, "narrative_id", "actor_id").agg(F.count("*").alias("n"))
    counted = authors.groupBy("window", "narrative_id").agg(F.count("*").alias("authors"))
    return counted.filter(F.col("authors") >= min_authors).select("narrative_id", F.col("window.end").alias("window_end"), "authors")


def edit_wars(edits: DataFrame, late: str = LATE, min_edits: int = WAR_EDITS, min_reverts: int = WAR_REVERTS) -> DataFrame:
    """Pages with enough edits and reverts in a clock hour; output mode update tells as soon as it is so."""
    hourly = edits.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "title").agg(
        F.count("*").alias("hourly_edits"), F.sum(F.when(F.col("is_revert"), 1).otherwise(0)).alias("hourly_reverts")
    )
    war = hourly.filter((F.col("hourly_edits") >= min_edits) & (F.col("hourly_reverts") >= min_reverts))
    return war.select("title", F.unix_timestamp("window.start").alias("hour"), "hourly_edits", "hourly_reverts")


def parent_authors(children: DataFrame, parents: DataFrame, days: int = LOOKBACK_DAYS, late: str = LATE) -> DataFrame:
    """Answers joined with the author of their parent, both streams: the parent is at most ``days`` older, so its
    state is dropped after that."""
    c = children.withWatermark("created_at", late)
    p = parents.select(
        F.col("platform").alias("_platform"), F.col("content_id").alias("_content"), F.col("actor_id").alias("target"),
        F.col("created_at").alias("_at"),
    ).withWatermark("_at", late)
    same = (
        (F.col("platform") == F.col("_platform")) & (F.col("parent_id") == F.col("_content"))
        & (F.col("_at") <= F.col("created_at")) & (F.col("_at") >= F.col("created_at") - F.make_dt_interval(days=F.lit(days)))
    )
    return c.join(p, same).select("content_id", "actor_id", "target", "platform", "created_at")


def alerts(signals: DataFrame, min_severity: tuple[str, ...] = ("medium", "high", "critical")) -> DataFrame:
    """New signals as alert rows; append mode emits each once."""
    rated = signals.withColumn("severity", severity_of("confidence"))
    return rated.filter(F.col("severity").isin(*min_severity)).select("signal_id", "type", "severity", "detected_at")


# --- foreachBatch steps: each can run again for the same batch without harm -------------------------------------------------

Step = Callable[[DataFrame, int], None]


def _read(spark, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(like.schema).parquet(path) if exists else like.limit(0)


def append_content(path: str) -> Step:
    """Append records whose natural key the table lacks; a repeated batch finds its keys already there."""

    def step(batch: DataFrame, _: int) -> None:
        known = _read(batch.sparkSession, path, batch.select("platform", "platform_content_id"))
        write_content(append_if_absent(batch, known), path)

    return step


def update_actors(path: str) -> Step:
    """Merge a batch into the actor table. Every batch writes its own version from the one before, so a repeated batch
    writes the same version again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = build_actors(batch)
        before = _read(batch.sparkSession, f"{path}/version={batch_id - 1}", fresh) if batch_id > 0 else fresh.limit(0)
        merge_actors(before, fresh).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return step


def image_matches(hash_path: str, match_path: str) -> Step:
    """Keep the batch's hashes and write the batch's records that match records of other platforms so far."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("content_id", "platform", "hash").distinct()
        fresh.write.mode("overwrite").parquet(f"{hash_path}/batch={batch_id}")
        known = batch.sparkSession.read.option("basePath", hash_path).parquet(hash_path).filter(F.col("batch") <= batch_id)
        touched = known.join(fresh.select("hash").distinct(), "hash", "left_semi").drop("batch")
        found = image_hash_matches(touched).join(fresh, ["content_id", "platform", "hash"], "left_semi")
        found.write.mode("overwrite").parquet(f"{match_path}/batch={batch_id}")

    return step
