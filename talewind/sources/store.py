"""The content table: append once, project, look up, age out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import actor_uuid
from talewind.functions.times import AsOf, since

NATURAL_KEY = ["platform", "platform_content_id"]
# Days a kind of row is kept.
RETENTION_DAYS = {"signals": 2, "clusters": 7, "alerts": 7, "migrations": 30, "links": 30, "image_hashes": 30}


def project_content_row(df: DataFrame) -> DataFrame:
    """Storage form: nested values kept, payload dropped, a date column to partition by."""
    return df.drop("raw_payload").withColumn("created_date", F.to_date("created_at"))


def append_if_absent(new: DataFrame, table: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` whose natural key the table lacks, one per key."""
    key = key or NATURAL_KEY
    return new.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def append_report(new: DataFrame, table: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row: read, inserted, skipped."""
    key = key or NATURAL_KEY
    known = table.select(*key).distinct().withColumn("_known", F.lit(1))
    keys = new.groupBy(*key).agg(F.count("*").alias("_n")).join(known, key, "left")
    inserted = F.coalesce(F.sum(F.when(F.col("_known").isNull(), 1)), F.lit(0))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return keys.agg(total.alias("rows_read"), inserted.alias("inserted"), (total - inserted).alias("skipped"))


def write_content(df: DataFrame, path: str) -> None:
    project_content_row(df).write.mode("append").partitionBy("platform", "created_date").parquet(path)


def retain(df: DataFrame, ts: str, as_of: AsOf, **ttl: int) -> DataFrame:
    """Rows younger than their life time, e.g. ``retain(signals, "detected_at", now, hours=48)``."""
    return df.filter(since(ts, as_of, **ttl))


def content_by_id(df: DataFrame, content_id: str) -> DataFrame:
    return df.filter(F.col("id") == content_id)


def content_by_platform_id(df: DataFrame, platform: str, platform_content_id: str) -> DataFrame:
    return df.filter((F.col("platform") == platform) & (F.col("platform_content_id") == platform_content_id))


def list_content(df: DataFrame, platform: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first."""
    if platform is not None:
        df = df.filter(F.col("platform") == platform)
    return df.orderBy(F.desc("created_at"), F.asc("platform_content_id")).offset(offset).limit(limit)


def author_of_content(df: DataFrame) -> DataFrame:
    """content id -> author, conversation, parent, type; the lookup table of edge building."""
    return df.select(
        "platform", "platform_content_id", actor_uuid("platform", "actor.platform_id").alias("actor_id"), "conversation_id",
        "parent_id", "content_type", "created_at",
    )


def flatten_content(df: DataFrame) -> DataFrame:
    """Posts as the operators read them: one flat row per record, actors by their derived id."""
    return df.select(
        F.col("platform_content_id").alias("content_id"), "platform", "content_type", "created_at",
        actor_uuid("platform", "actor.platform_id").alias("actor_id"), "text", "title", "url", "parent_id", "root_id",
        "mentions", "forwarded_from", "narrative_ids", "actor", "engagement", "language",
    )
