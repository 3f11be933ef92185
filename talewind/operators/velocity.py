"""Engagement snapshots: when to take them, how fast counters grow, when growth is unusual; edit wars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.times import AsOf, bucket, instant, micros
from talewind.operators.skew import running_sum, with_last_two

# Seconds after posting at which counters are read again.
SNAPSHOT_SECONDS = (300, 900, 3600, 21600, 86400, 259200)
ANOMALY_LIKES, ANOMALY_HIGH = 500, 2000
WAR_EDITS, WAR_REVERTS = 10, 3
DUE_BATCH = 100


def snapshot_schedule(content: DataFrame) -> DataFrame:
    """Six poll times per record."""
    seconds = F.explode(F.array(*[F.lit(s) for s in SNAPSHOT_SECONDS])).alias("interval")
    polls = content.select("content_id", "platform", "created_at", seconds)
    return polls.select(
        "content_id", "platform", "interval", (F.col("created_at") + F.make_dt_interval(secs=F.col("interval"))).alias("poll_at")
    )


def due_polls(schedule: DataFrame, captured: DataFrame, as_of: AsOf, limit: int = DUE_BATCH) -> DataFrame:
    """The oldest due polls not yet captured; a batch of ``limit`` is what one polling step takes."""
    due = schedule.filter(F.col("poll_at") <= instant(as_of))
    open_polls = due.join(captured.select("content_id", "interval"), ["content_id", "interval"], "left_anti")
    return open_polls.orderBy("poll_at", "content_id", "interval").limit(limit)


def engagement_velocity(snapshots: DataFrame) -> DataFrame:
    """Likes and replies per hour since the previous snapshot, and the acceleration where there are three.

    ``snapshots``: content_id, ts, likes, replies. The first snapshot and those at a zero distance give no row.
    """
    timed = snapshots.select("content_id", "ts", "likes", "replies", micros("ts").alias("_us"))
    order = ["_us", "likes", "replies"]
    both = with_last_two(timed, ["content_id"], "_us", order, order)

    def hours(later: str, earlier: str):
        return (F.col(f"{later}_us") - F.col(f"{earlier}_us")) / 3_600_000_000

    def rate(name: str, later: str, earlier: str):
        return F.when(hours(later, earlier) != 0, (F.col(f"{later}{name}") - F.col(f"{earlier}{name}")) / hours(later, earlier))

    likes = rate("likes", "", "_one.")
    acceleration = (likes - rate("likes", "_one.", "_two.")) / hours("", "_one.")
    return both.filter(likes.isNotNull()).select(
        "content_id", "ts", likes.alias("likes_per_hour"), rate("replies", "", "_one.").alias("replies_per_hour"),
        acceleration.alias("acceleration"),
    )


def latest_velocity(velocity: DataFrame) -> DataFrame:
    """Last velocity per record."""
    rest = F.struct("likes_per_hour", "replies_per_hour", "acceleration")
    return velocity.groupBy("content_id").agg(F.max("ts").alias("ts"), F.max_by(rest, "ts").alias("_v")).select(
        "content_id", "ts", "_v.*"
    )


def velocity_anomaly(velocity: DataFrame, likes: float = ANOMALY_LIKES, high: float = ANOMALY_HIGH) -> DataFrame:
    flagged = velocity.filter(F.col("likes_per_hour") > likes)
    return flagged.withColumn("severity", F.when(F.col("likes_per_hour") > high, "high").otherwise("medium"))


def edit_wars(edits: DataFrame, min_edits: int = WAR_EDITS, min_reverts: int = WAR_REVERTS) -> DataFrame:
    """Reverts at which a page has, within the clock hour so far, enough edits and reverts.

    ``edits``: title, edit_id, ts, is_revert.
    """
    flagged = edits.select(
        "title", "edit_id", "ts", "is_revert", bucket("ts", 3600).alias("hour"), micros("ts").alias("_us"), F.lit(1).alias("_one"),
        F.when(F.col("is_revert"), 1).otherwise(0).alias("_revert"),
    )
    # An hour's edits are cut by the minute; the sums of minutes read the edits once more.
    counted = running_sum(
        flagged, ["title", "hour"], "_us", ["_us", "edit_id"], {"hourly_edits": "_one", "hourly_reverts": "_revert"},
        width=60_000_000, written=False,
    )
    war = F.col("is_revert") & (F.col("hourly_edits") >= min_edits) & (F.col("hourly_reverts") >= min_reverts)
    return counted.filter(war).select("title", "hour", "edit_id", "ts", "hourly_edits", "hourly_reverts")
