"""When stories reach further platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.times import AsOf, bucket, instant, seconds_between
from talewind.operators.skew import with_previous

# Some months of buckets.
SLICE_SECONDS = 10_000_000
from talewind.schemas import MIGRATING_STATES


def platform_timeline(posts: DataFrame) -> DataFrame:
    """First time and number of posts per (narrative, platform)."""
    return posts.groupBy("narrative_id", "platform").agg(
        F.min("created_at").alias("first_seen"), F.count("*").alias("content_count")
    )


def detect_migrations(
    timeline: DataFrame, known: DataFrame | None = None, states: DataFrame | None = None, as_of: AsOf | None = None
) -> DataFrame:
    """One event per newly reached platform. The origin is the earliest platform (ties: alphabetical) and is no target.

    ``known``: narrative_id, platform already reported. ``states``: narrative_id, status; only spreading states count.
    """
    if states is not None:
        spreading = states.filter(F.col("status").isin(*MIGRATING_STATES)).select("narrative_id")
        timeline = timeline.join(spreading, "narrative_id", "left_semi")
    # One row per narrative and platform: at most as many rows per narrative as there are platforms.
    origin = timeline.groupBy("narrative_id").agg(
        F.min_by("platform", F.struct("first_seen", "platform")).alias("from_platform"), F.min("first_seen").alias("_start")
    )
    reached = timeline if known is None else timeline.join(known, ["narrative_id", "platform"], "left_anti")
    events = reached.join(origin, "narrative_id").filter(F.col("platform") != F.col("from_platform"))
    out = events.select(
        "narrative_id", "from_platform", F.col("platform").alias("to_platform"),
        F.greatest(F.lit(0), F.floor(seconds_between("first_seen", "_start"))).cast("long").alias("migration_time_seconds"),
        F.col("first_seen").alias("reached_at"),
    )
    if as_of is not None:
        out = out.withColumn("detected_at", instant(as_of)).withColumn("id", row_key("narrative_id", "to_platform"))
    return out


def known_after(known: DataFrame, migrations: DataFrame) -> DataFrame:
    """Reported platforms after a run."""
    fresh = migrations.select("narrative_id", F.col("to_platform").alias("platform"))
    return known.select("narrative_id", "platform").unionByName(fresh).distinct()


def narrative_snapshots(posts: DataFrame, grain_seconds: int = 3600) -> DataFrame:
    """Lifecycle series: posts, actors, mean sentiment per bucket, and velocity = change of posts per hour since the
    previous bucket with posts. ``posts``: narrative_id, actor_id, created_at, sentiment."""
    counted = posts.groupBy("narrative_id", bucket("created_at", grain_seconds).alias("bucket")).agg(
        F.count("*").alias("content_count"),
        F.count_distinct("actor_id").alias("actor_count"),
        F.avg("sentiment").alias("sentiment_avg"),
    )
    before = with_previous(
        counted, ["narrative_id"], "bucket", ["bucket"], {"_count": "content_count", "_bucket": "bucket"}, width=SLICE_SECONDS
    )
    hours = (F.col("bucket") - F.col("_bucket")) / 3600
    change = (F.col("content_count") - F.col("_count")) / hours
    return before.withColumn("velocity", F.coalesce(change, F.lit(0.0))).drop("_count", "_bucket")
