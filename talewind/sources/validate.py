"""Record checks: rows that break the record type go to a reject output with their reason, the run goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.schemas import CONTENT_TYPES, ENTITY_TYPES, PLATFORMS, SENTIMENTS


def reject_reason() -> Column:
    """First rule a content row breaks, null for a good row."""
    entities = F.col("nlp.entities")
    score = F.col("nlp.sentiment_score")
    rules = [
        ("missing platform", F.col("platform").isNull()),
        ("unknown platform", ~F.col("platform").isin(*PLATFORMS)),
        ("missing content_type", F.col("content_type").isNull()),
        ("unknown content_type", ~F.col("content_type").isin(*CONTENT_TYPES)),
        ("missing platform_content_id", F.col("platform_content_id").isNull()),
        ("missing created_at", F.col("created_at").isNull()),
        ("missing actor", F.col("actor.platform_id").isNull() | F.col("actor.username").isNull()),
        ("unknown sentiment", ~F.col("nlp.sentiment").isin(*SENTIMENTS)),
        ("sentiment_score out of bounds", ~score.between(-1, 1)),
        ("entity confidence out of bounds", F.exists(entities, lambda e: ~e["confidence"].between(0, 1))),
        ("unknown entity_type", F.exists(entities, lambda e: ~e["entity_type"].isin(*ENTITY_TYPES))),
    ]
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return reason


def check_content(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason())


def validate_content(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad). ``df`` has the content columns, or ``record`` and ``value`` as read from a topic."""
    if "record" in df.columns:
        parsed = df.select("value", F.col("record").isNull().alias("_unreadable"), "record.*")
        checked = check_content(parsed).withColumn(
            "reject_reason", F.when(F.col("_unreadable"), "unreadable").otherwise(F.col("reject_reason"))
        ).drop("_unreadable")
        good = checked.filter("reject_reason IS NULL").drop("reject_reason", "value")
    else:
        checked = check_content(df)
        good = checked.filter("reject_reason IS NULL").drop("reject_reason")
    return good, checked.filter("reject_reason IS NOT NULL")


def out_of_bounds(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows whose score lies outside its bounds (confidence, similarity)."""
    return df.filter(~F.col(column).between(low, high))
