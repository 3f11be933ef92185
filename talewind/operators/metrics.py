"""Counters, gauges, timers and the dashboards built on them.

Metric events: ``name``, ``tags`` map, ``kind`` ('counter' | 'gauge' | 'timer'), ``value`` double, ``ts`` timestamp.
Counter events may come ready as any frame with the key columns passed as ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.times import AsOf, bucket, instant, since
from talewind.operators.skew import top_per_group

# Counter families summed per platform; seconds per counter grain.
FAMILIES = ("posts", "comments", "articles")
GRAINS = {"minute": 60, "hour": 3600, "day": 86400}
TIMINGS_KEPT = 1000
RATE_MINUTES = 5


def counter_rollup(events: DataFrame, keys: Sequence[str] = ("name", "tags"), value: str = "value", ts: str = "ts") -> DataFrame:
    """Counters per minute, hour, day and in total: ``grain``, ``bucket`` (epoch seconds, null for the total), ``total``.

    The minute table is aggregated once; the coarser grains are rolled up from its rows, not from the events.
    """
    rows = events.filter(F.col("kind") == "counter") if "kind" in events.columns else events
    names = [k for k in keys if k != "tags"]
    if "tags" in keys:
        # Maps cannot be grouped: sorted entries can.
        rows = rows.withColumn("tags", F.array_sort(F.map_entries("tags")))
        names.append("tags")
    minutes = rows.groupBy(*names, bucket(ts, 60).alias("_minute")).agg(F.sum(value).alias("total"))
    at = [
        F.struct(F.lit(g).alias("grain"), (F.floor(F.col("_minute") / s) * s).cast("long").alias("bucket"))
        for g, s in GRAINS.items()
    ]
    at.append(F.struct(F.lit("total").alias("grain"), F.lit(None).cast("long").alias("bucket")))
    spread = minutes.select(*names, "total", F.inline(F.array(*at)))
    out = spread.groupBy(*names, "grain", "bucket").agg(F.sum("total").alias("total"))
    return out.withColumn("tags", F.map_from_entries("tags")) if "tags" in keys else out


def gauge_latest(events: DataFrame, as_of: AsOf, keys: Sequence[str] = ("name",), hours: int = 1) -> DataFrame:
    """Last value per gauge, if not older than its life time."""
    fresh = events.filter(since("ts", as_of, hours=hours) & (F.col("ts") <= instant(as_of)))
    return fresh.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def timer_recent(events: DataFrame, keys: Sequence[str] = ("name",), n: int = TIMINGS_KEPT, tie: str = "value") -> DataFrame:
    """Last ``n`` durations per timer, newest first."""
    return top_per_group(events, list(keys), [F.desc("ts"), F.desc(tie)], n)


def _last(as_of: AsOf, n: int, seconds: int) -> Column:
    """``ts`` lies in the running minute or hour (of ``seconds``) or the n - 1 before it: plain bounds, so that a scan can skip files."""
    start = bucket(instant(as_of), seconds)
    return (F.col("ts") >= F.timestamp_seconds(start - (n - 1) * seconds)) & (F.col("ts") < F.timestamp_seconds(start + seconds))


def rate_per_minute(events: DataFrame, as_of: AsOf, keys: Sequence[str] = ("name",), value: str = "value") -> DataFrame:
    """Mean per minute over the running minute and the four before it."""
    recent = events.filter(_last(as_of, RATE_MINUTES, 60))
    return recent.groupBy(*keys).agg((F.sum(value) / float(RATE_MINUTES)).alias("per_minute"))


def hourly_counts(
    events: DataFrame, as_of: AsOf, hours: int = 24, keys: Sequence[str] = ("name",), value: str = "value", names: DataFrame | None = None,
) -> DataFrame:
    """Zero-filled hour series per key: ``hour_offset`` (0, -1, ...), ``hour`` (epoch seconds), ``total``.

    Keys without recent events get their zeros too: those of ``names`` (such as totals of a roll-up), else all of ``events``.
    """
    now = bucket(instant(as_of), 3600)
    counted = events.filter(_last(as_of, hours, 3600)).groupBy(*keys, bucket("ts", 3600).alias("hour")).agg(F.sum(value).alias("_n"))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    grid = (
        (events if names is None else names).select(*keys).distinct().withColumn("_o", offsets)
        .select(*keys, (-F.col("_o")).alias("hour_offset"), (now - F.col("_o") * 3600).alias("hour"))
    )
    return grid.join(counted, [*keys, "hour"], "left").select(
        *keys, "hour_offset", "hour", F.coalesce("_n", F.lit(0)).alias("total")
    )


def count_for_day(events: DataFrame, day: str, keys: Sequence[str] = ("name",), value: str = "value") -> DataFrame:
    start = F.lit(day).cast("timestamp")
    inside = (F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY"))
    return events.filter(inside).groupBy(*keys).agg(F.sum(value).alias("total"))


def _today(as_of: AsOf) -> Column:
    return (F.col("ts") >= F.date_trunc("day", instant(as_of))) & (F.col("ts") <= instant(as_of))


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _with_totals(ingested: DataFrame, totals: DataFrame | None) -> tuple[DataFrame, Column]:
    """Rows to sum and which of them make up totals: without ``totals`` all, else those, which have no time."""
    if totals is None:
        return ingested, F.lit(True)
    untimed = totals.select("platform", "family", "n", F.lit(None).cast("timestamp").alias("ts"))
    return ingested.select("platform", "family", "n", "ts").unionByName(untimed), F.col("ts").isNull()


def source_health(ingested: DataFrame, as_of: AsOf, totals: DataFrame | None = None) -> DataFrame:
    """One row per platform. ``ingested``: platform, family, n, ts, where family is one of posts, comments, articles,
    errors, pauses. Grey without records, red on more than 10 errors or no recent records, yellow on any error or
    more than 5 pauses, else green. One pass: all figures are conditional sums. With ``totals`` (platform, family, n) of all
    time, ``ingested`` needs only hold the day and the last minutes."""
    records = F.col("family").isin(*FAMILIES)
    recent = _last(as_of, RATE_MINUTES, 60)
    rows, whole = _with_totals(ingested, totals)
    figures = rows.groupBy("platform").agg(
        _sum_if(records & whole).alias("records_total"),
        _sum_if(records & _today(as_of)).alias("records_today"),
        (_sum_if(records & recent) / float(RATE_MINUTES)).alias("records_per_minute"),
        _sum_if((F.col("family") == "errors") & _today(as_of)).alias("errors_today"),
        _sum_if((F.col("family") == "pauses") & _today(as_of)).alias("pauses_today"),
    )
    status = (
        F.when(F.col("records_total") == 0, "gray")
        .when((F.col("errors_today") > 10) | (F.col("records_per_minute") == 0), "red")
        .when((F.col("errors_today") > 0) | (F.col("pauses_today") > 5), "yellow")
        .otherwise("green")
    )
    return figures.withColumn("status", status)


def source_overview(health: DataFrame) -> DataFrame:
    """Totals over all sources."""
    return health.agg(
        F.sum("records_total").alias("total_records"),
        F.sum("records_today").alias("records_today"),
        F.round(F.sum("records_per_minute"), 1).alias("records_per_minute"),
        F.sum(F.when(F.col("status").isin("green", "yellow"), 1).otherwise(0)).alias("active_sources"),
        F.count("*").alias("total_sources"),
    )


def ingestion_rate(ingested: DataFrame, as_of: AsOf, hours: int = 24, totals: DataFrame | None = None) -> DataFrame:
    """Zero-filled hour series per platform, the three families summed. ``totals``: see source_health."""
    records = ingested.filter(F.col("family").isin(*FAMILIES))
    names = None if totals is None else totals.filter(F.col("family").isin(*FAMILIES))
    return hourly_counts(records, as_of, hours, keys=["platform"], value="n", names=names)


def source_detail(ingested: DataFrame, platform: str, as_of: AsOf, totals: DataFrame | None = None) -> DataFrame:
    """Figures of one platform. ``totals``: see source_health."""
    rows, whole = _with_totals(ingested, totals)
    own = rows.filter(F.col("platform") == platform)
    sums = [_sum_if((F.col("family") == family) & whole).alias(f"total_{family}") for family in FAMILIES]
    recent = _last(as_of, RATE_MINUTES, 60) & F.col("family").isin(*FAMILIES)
    return own.groupBy("platform").agg(
        *sums,
        _sum_if((F.col("family") == "errors") & _today(as_of)).alias("errors_today"),
        F.round(_sum_if(recent) / float(RATE_MINUTES), 1).alias("records_per_minute"),
    )


# Stage and figure each day counter belongs to.
STAGE_COUNTERS = {
    "embeddings.parse_errors": ("embedding", "errors_today"),
    "clustering.errors": ("clustering", "errors_today"),
    "narratives.validated": ("narrative_validation", "validated_today"),
    "narratives.rejected": ("narrative_validation", "rejected_today"),
    "engagement.snapshots.captured": ("engagement_poller", "snapshots_today"),
    "engagement.snapshots.errors": ("engagement_poller", "errors_today"),
    "engagement.anomalies.detected": ("engagement_poller", "anomalies_today"),
    "images.hashed": ("image_hasher", "hashed_today"),
    "images.hash_errors": ("image_hasher", "errors_today"),
    "images.cross_platform_detected": ("image_hasher", "cross_platform_today"),
}
# Stage and figure of each gauge.
STAGE_GAUGES = {
    "embeddings.queue_depth": ("embedding", "queue_depth"),
    "clustering.clusters_found": ("clustering", "clusters_found"),
    "clustering.noise_ratio": ("clustering", "noise_ratio"),
    "engagement.queue_depth": ("engagement_poller", "queue_depth"),
}


def _stage_names(names: dict[str, tuple[str, str]]) -> Column:
    return F.create_map(*[x for n, (s, f) in names.items() for x in (F.lit(n), F.struct(F.lit(s).alias("stage"), F.lit(f).alias("figure")))])


def pipeline_status(metrics: DataFrame, as_of: AsOf) -> DataFrame:
    """Figures of the day per pipeline stage, long form: stage, figure, value."""
    known = list(STAGE_COUNTERS)
    today = metrics.filter((F.col("kind") == "counter") & F.col("name").isin(known) & _today(as_of))
    counters = today.groupBy("name").agg(F.sum("value").alias("value")).withColumn(
        "_at", F.try_element_at(_stage_names(STAGE_COUNTERS), F.col("name"))
    )
    gauges = gauge_latest(metrics.filter((F.col("kind") == "gauge") & F.col("name").isin(*STAGE_GAUGES)), as_of)
    gauges = gauges.select("name", "value").withColumn("_at", F.try_element_at(_stage_names(STAGE_GAUGES), F.col("name")))
    throughput = rate_per_minute(metrics.filter((F.col("kind") == "counter") & (F.col("name") == "embeddings.generated")), as_of)
    rate = throughput.select(
        "name", F.round("per_minute", 1).alias("value"),
        F.struct(F.lit("embedding").alias("stage"), F.lit("throughput_per_minute").alias("figure")).alias("_at"),
    )
    every = counters.unionByName(gauges).unionByName(rate)
    return every.select("_at.stage", "_at.figure", "value")


def platform_stats(ingested: DataFrame, as_of: AsOf) -> DataFrame:
    """Total and today per platform, the three families summed."""
    records = ingested.filter(F.col("family").isin(*FAMILIES))
    return records.groupBy("platform").agg(F.sum("n").alias("total"), _sum_if(_today(as_of)).alias("today"))
