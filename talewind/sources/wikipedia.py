"""Edits of the encyclopedia. Columns: id, title, user, comment, namespace, type, wiki, server_name, timestamp, minor,
bot, anon, revision struct(new, old), length struct(new, old)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import blank_to_null, diff_size, is_high_signal, revert_flag
from talewind.functions.times import AsOf, parse_epoch_ts
from talewind.sources.record import actor, as_content


def is_watched_edit() -> Column:
    """English article edits on watched titles."""
    return (
        (F.col("wiki") == "enwiki") & (F.col("type") == "edit") & (F.col("namespace") == 0)
        & is_high_signal(F.coalesce("title", F.lit("")))
    )


def normalize_wikipedia(changes: DataFrame, as_of: AsOf) -> DataFrame:
    new, old = F.coalesce(F.col("revision.new"), F.lit(0)), F.coalesce(F.col("revision.old"), F.lit(0))
    user = F.coalesce("user", F.lit("unknown"))
    return as_content(
        changes.filter(is_watched_edit()), as_of, "wikipedia",
        content_type=F.lit("edit"),
        platform_content_id=F.concat(
            F.lit("wiki:"), F.coalesce("id", F.lit(0)).cast("string"), F.lit(":"), new.cast("string")
        ),
        created_at=parse_epoch_ts("timestamp", as_of),
        text=blank_to_null("comment"),
        title=F.col("title"),
        url=F.concat(
            F.lit("https://en.wikipedia.org/w/index.php?diff="), new.cast("string"), F.lit("&oldid="), old.cast("string")
        ),
        language=F.lit("en"),
        actor=actor(
            platform_id=user, username=user, display_name=user, is_verified=~F.coalesce("anon", F.lit(False))
        ),
        raw_payload=F.to_json(
            F.struct(
                "namespace", new.alias("rev_id"), old.alias("old_rev"),
                diff_size("length.new", "length.old").alias("diff_size"),
                F.coalesce("minor", F.lit(False)).alias("is_minor"), F.coalesce("bot", F.lit(False)).alias("is_bot"),
                revert_flag("comment").alias("is_revert"), "type", "wiki", "server_name",
            )
        ),
    )
