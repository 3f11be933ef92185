"""Data part of briefings, and their list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.times import AsOf, instant, since
from talewind.operators.metrics import platform_stats
from talewind.operators.skew import top_per_group

TOP_NARRATIVES, MIGRATIONS_PER_NARRATIVE, MIGRATIONS_ALL, KEPT = 10, 10, 50, 100


def briefing_snapshot(
    narratives: DataFrame, clusters: DataFrame, migrations: DataFrame, behavioral: DataFrame, ingested: DataFrame, as_of: AsOf,
    hours: int = 24,
) -> DataFrame:
    """Everything one briefing reports, long form: section, position, key, payload (JSON).

    A section is a bounded list except clusters and alerts, which are as many as there are; a table, not one document,
    so none of them passes through a single row.
    """

    def recent(df: DataFrame, ts: str) -> DataFrame:
        return df.filter(since(ts, as_of, hours=hours) & (F.col(ts) <= instant(as_of)))

    def section(df: DataFrame, name: str, key: str, position=None) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "_position"]))
        at = F.col("_position") if position is None else position
        return df.select(
            F.lit(name).alias("section"), at.cast("int").alias("position"), F.col(key).cast("string").alias("key"), body.alias("payload")
        )

    top = narratives.orderBy(F.desc("content_count"), F.asc("narrative_id")).limit(TOP_NARRATIVES)
    ranked = top_per_group(top.withColumn("_all", F.lit(1)), ["_all"], [F.desc("content_count"), F.asc("narrative_id")], TOP_NARRATIVES, "_position")
    moved = top_per_group(
        recent(migrations, "detected_at"), ["narrative_id"], [F.desc("detected_at"), F.asc("to_platform")], MIGRATIONS_PER_NARRATIVE
    ).drop("rank").orderBy(F.desc("detected_at"), F.asc("narrative_id"), F.asc("to_platform")).limit(MIGRATIONS_ALL)
    none = F.lit(None)
    return (
        section(ranked.drop("_all"), "narratives", "narrative_id")
        .unionByName(section(clusters.filter(F.col("status") == "active"), "coordination_clusters", "cluster_id", none))
        .unionByName(section(moved, "migration_events", "narrative_id", none))
        .unionByName(section(recent(behavioral, "detected_at"), "behavioral_alerts", "id", none))
        .unionByName(section(platform_stats(ingested, as_of), "platform_stats", "platform", none))
    )


def briefing_header(briefing_type: str, as_of: AsOf, snapshot: DataFrame, hours: int = 24) -> DataFrame:
    """Header row of a briefing: id, type, period and the size of each section."""
    end = instant(as_of)
    sizes = snapshot.groupBy("section").agg(F.count("*").alias("n"))
    # Five sections.
    packed = sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("section_sizes"))
    return packed.select(
        row_key(F.lit(briefing_type), end).alias("id"), F.lit(briefing_type).alias("type"), end.alias("generated_at"),
        (end - F.make_dt_interval(hours=F.lit(hours))).alias("period_start"), end.alias("period_end"), "section_sizes",
    )


def list_briefings(briefings: DataFrame, limit: int = 20) -> DataFrame:
    """Headers of the newest briefings, at most as many as are kept."""
    newest = briefings.orderBy(F.desc("generated_at"), F.asc("id")).limit(min(limit, KEPT))
    return newest.select("id", "type", "generated_at", "period_start", "period_end")


def latest_briefing(briefings: DataFrame, briefing_type: str | None = None) -> DataFrame:
    """Newest briefing per type, or of one type."""
    if briefing_type:
        briefings = briefings.filter(F.col("type") == briefing_type)
    return top_per_group(briefings, ["type"], [F.desc("generated_at"), F.asc("id")], 1).drop("rank")


def briefing(briefings: DataFrame, briefing_id: str) -> DataFrame:
    return briefings.filter(F.col("id") == briefing_id)
