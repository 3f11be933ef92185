"""Engagement profiles of communities and their shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.text import words
from talewind.functions.times import AsOf, instant

METRICS = (
    "avg_comment_length", "reply_ratio", "repost_ratio", "original_content_ratio", "unique_author_ratio",
    "peak_hour_concentration",
)
MIN_POSTS = 20
CHANGE = 0.3
SHIFTS_HIGH = 3


def engagement_profile(posts: DataFrame, group: str, min_posts: int = MIN_POSTS) -> DataFrame:
    """Six engagement figures per group. ``posts``: group, author_id, text, is_reply, is_repost, hour.

    Posts are first reduced to one row per (group, author, hour): every figure but the word mean then needs only
    counts, and a large group is spread over its authors before it is summed.
    """
    has_text = F.coalesce("text", F.lit("")) != ""
    part = posts.groupBy(group, "author_id", "hour").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("is_reply"), 1).otherwise(0)).alias("replies"),
        F.sum(F.when(F.col("is_repost"), 1).otherwise(0)).alias("reposts"),
        F.sum(F.when(has_text, F.size(words("text")))).alias("n_words"),
        F.count(F.when(has_text, 1)).alias("n_texts"),
    )
    author = part.groupBy(group, "author_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "replies", "reposts", "n_words", "n_texts")],
        *[F.sum(F.when(F.coalesce("hour", F.lit(12)) == h, F.col("n")).otherwise(0)).alias(f"_h{h}") for h in range(24)],
    )
    total = author.groupBy(group).agg(
        *[F.sum(c).alias(c) for c in ("n", "replies", "reposts", "n_words", "n_texts")],
        F.count("*").alias("authors"),
        F.greatest(*[F.sum(f"_h{h}") for h in range(24)]).alias("peak"),
    )
    return total.filter(F.col("n") >= min_posts).select(
        group,
        F.coalesce(F.col("n_words") / F.nullif(F.col("n_texts"), F.lit(0)), F.lit(0.0)).alias("avg_comment_length"),
        (F.col("replies") / F.col("n")).alias("reply_ratio"),
        (F.col("reposts") / F.col("n")).alias("repost_ratio"),
        ((F.col("n") - F.col("replies") - F.col("reposts")) / F.col("n")).alias("original_content_ratio"),
        (F.col("authors") / F.col("n")).alias("unique_author_ratio"),
        (F.col("peak") / F.col("n")).alias("peak_hour_concentration"),
    )


def metric_changes(current: DataFrame, baseline: DataFrame, group: str) -> DataFrame:
    """Metrics that changed by more than the threshold, long form."""
    now = current.unpivot([group], list(METRICS), "metric", "current")
    then = baseline.unpivot([group], list(METRICS), "metric", "baseline")
    change = F.abs(F.col("current") - F.col("baseline")) / F.col("baseline")
    both = now.join(then, [group, "metric"]).filter(F.col("baseline") > 0).withColumn("change", change)
    return both.filter(F.col("change") > CHANGE).select(
        group, "metric", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"),
        F.round(F.col("change") * 100, 1).alias("change_pct"),
    )


def engagement_shift(current: DataFrame, baseline: DataFrame, group: str, as_of: AsOf | None = None) -> DataFrame:
    """One alert per group with at least one change; three or more are of high severity."""
    changes = metric_changes(current, baseline, group)
    out = changes.groupBy(group).agg(
        F.count("*").alias("shift_count"),
        # At most six.
        F.array_sort(F.collect_list(F.struct("metric", "baseline", "current", "change_pct"))).alias("shifts"),
    ).select(
        group, F.lit("engagement_shift").alias("type"),
        F.when(F.col("shift_count") >= SHIFTS_HIGH, "high").otherwise("medium").alias("severity"), "shift_count", "shifts",
    )
    if as_of is not None:
        out = out.withColumn("detected_at", instant(as_of)).withColumn("id", row_key("type", group, "detected_at"))
    return out
