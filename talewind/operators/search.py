"""User-level queries over the result tables. Limits here are page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talewind.functions.scores import severity_of
from talewind.functions.text import excerpt
from talewind.functions.times import AsOf, instant, since

MIGRATIONS_SHOWN = 50


def _matching(content: DataFrame, q: str | None, platform: str | None, content_type: str | None, after: AsOf | None) -> DataFrame:
    if q:
        content = content.filter(F.lower("text").contains(q.lower()))
    if platform:
        content = content.filter(F.col("platform") == platform)
    if content_type:
        content = content.filter(F.col("content_type") == content_type)
    if after is not None:
        content = content.filter(F.col("created_at") >= instant(after))
    return content


def search_content(
    content: DataFrame, q: str | None = None, platform: str | None = None, content_type: str | None = None,
    after: AsOf | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of matching records, newest first, texts cut to an excerpt."""
    page = _matching(content, q, platform, content_type, after)
    page = page.orderBy(F.desc("created_at"), F.asc("content_id")).offset(offset).limit(limit)
    return page.withColumn("text", excerpt("text"))


def search_total(
    content: DataFrame, q: str | None = None, platform: str | None = None, content_type: str | None = None,
    after: AsOf | None = None,
) -> DataFrame:
    return _matching(content, q, platform, content_type, after).agg(F.count("*").alias("total"))


def list_narratives(state: DataFrame, status: str | None = None, limit: int = 50, after: str | None = None) -> DataFrame:
    """A page in id order; ``after`` is the last id of the page before."""
    if status:
        state = state.filter(F.col("status") == status)
    if after is not None:
        state = state.filter(F.col("narrative_id") > after)
    return state.orderBy("narrative_id").limit(limit)


def narrative_velocity(snapshots: DataFrame, narrative_id: object) -> DataFrame:
    own = snapshots.filter(F.col("narrative_id") == F.lit(narrative_id))
    return own.select("narrative_id", "bucket", "content_count", "actor_count", "velocity").orderBy("bucket")


def narrative_detail(state: DataFrame, snapshots: DataFrame, narrative_id: object) -> DataFrame:
    """State of one narrative with its latest and highest velocity."""
    own = snapshots.filter(F.col("narrative_id") == F.lit(narrative_id)).groupBy("narrative_id").agg(
        F.max_by("velocity", "bucket").alias("current_velocity"), F.max("velocity").alias("max_velocity"),
        F.sum("content_count").alias("content_count"),
    )
    return state.filter(F.col("narrative_id") == F.lit(narrative_id)).join(own, "narrative_id", "left")


def narrative_predictions(predictions: DataFrame, narrative_id: object) -> DataFrame:
    return predictions.filter(F.col("narrative_id") == F.lit(narrative_id))


def narrative_migrations(migrations: DataFrame, narrative_id: object, limit: int = MIGRATIONS_SHOWN) -> DataFrame:
    own = migrations.filter(F.col("narrative_id") == F.lit(narrative_id))
    return own.orderBy(F.desc("reached_at"), F.asc("to_platform")).limit(limit)


def list_clusters(clusters: DataFrame, min_confidence: float = 0.0, limit: int = 50) -> DataFrame:
    strong = clusters.filter(F.col("confidence") >= min_confidence)
    return strong.orderBy(F.desc("confidence"), F.asc("cluster_id")).limit(limit)


def cluster(clusters: DataFrame, cluster_id: str) -> DataFrame:
    return clusters.filter(F.col("cluster_id") == cluster_id)


def list_signals(signals: DataFrame, as_of: AsOf, hours: int = 24, signal_type: str | None = None, limit: int = 100) -> DataFrame:
    recent = signals.filter(since("detected_at", as_of, hours=hours) & (F.col("detected_at") <= instant(as_of)))
    if signal_type:
        recent = recent.filter(F.col("type") == signal_type)
    return recent.orderBy(F.desc("detected_at"), F.asc("signal_id")).limit(limit)


def _text(name: str, df: DataFrame) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast("string").alias(name)


def all_alerts(signals: DataFrame, behavioral: DataFrame, migrations: DataFrame) -> DataFrame:
    """One shape for the three kinds: id, category, type, narrative_id, community_id, severity, detected_at. A signal's
    severity comes from its confidence; a migration is of high severity."""
    s = signals.select(
        F.col("signal_id").alias("id"), F.lit("coordination").alias("category"), "type", _text("narrative_id", signals),
        F.lit(None).cast("string").alias("community_id"), severity_of("confidence").alias("severity"), "detected_at",
    )
    b = behavioral.select(
        "id", F.lit("behavioral").alias("category"), "type", _text("narrative_id", behavioral), _text("community_id", behavioral),
        "severity", "detected_at",
    )
    m = migrations.select(
        "id", F.lit("migration").alias("category"), F.lit("migration").alias("type"), _text("narrative_id", migrations),
        F.lit(None).cast("string").alias("community_id"), F.lit("high").alias("severity"), "detected_at",
    )
    return s.unionByName(b).unionByName(m)


def alert_feed(alerts: DataFrame, as_of: AsOf, hours: int = 24, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Newest alerts first."""
    recent = alerts.filter(since("detected_at", as_of, hours=hours) & (F.col("detected_at") <= instant(as_of)))
    if severity:
        recent = recent.filter(F.col("severity") == severity)
    return recent.orderBy(F.desc("detected_at"), F.asc("id")).limit(limit)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with ``acknowledged`` and who did it (the first client). ``acks``: id, client, at."""
    first = acks.groupBy("id").agg(F.min_by("client", F.struct("at", "client")).alias("acknowledged_by"))
    return alerts.join(first, "id", "left").withColumn("acknowledged", F.col("acknowledged_by").isNotNull())


def list_communities(summary: DataFrame, limit: int = 500) -> DataFrame:
    return summary.orderBy(F.desc("member_count"), F.asc("community_id")).limit(limit)


def list_bridges(bridges: DataFrame, limit: int = 50) -> DataFrame:
    return bridges.orderBy(F.desc("bridge_score"), F.asc("actor_id")).limit(limit)


def _named_like(q: str) -> Column:
    needle = q.lower()
    return F.lower("username").contains(needle) | F.lower(F.coalesce("display_name", F.lit(""))).contains(needle)


def search_actors(actors: DataFrame, q: str, platform: str | None = None, min_influence: float = 0.0, limit: int = 50) -> DataFrame:
    """Accounts by name, most influential first."""
    found = actors.filter(_named_like(q))
    if platform:
        found = found.filter(F.col("primary_platform") == platform)
    if min_influence > 0:
        found = found.filter(F.col("influence_score") >= min_influence)
    return found.orderBy(F.desc("influence_score"), F.asc("actor_id")).limit(limit)


def global_search(
    q: str, narratives: DataFrame, actors: DataFrame, alerts: DataFrame, platform: str | None = None, kind: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Narratives, actors and alerts that mention ``q``: kind, id, label, detail; up to ``limit`` of each kind.

    ``platform`` restricts narratives to those that reached it and actors to those on it; ``kind`` to one result kind.
    """
    needle = q.lower()
    n = narratives.filter(F.lower(F.to_json(F.struct(*[F.col(c) for c in narratives.columns]))).contains(needle))
    if platform:
        n = n.filter(F.array_contains("platforms", platform))
    n = n.orderBy("narrative_id").limit(limit).select(
        F.lit("narrative").alias("kind"), F.col("narrative_id").cast("string").alias("id"), F.col("summary").alias("label"),
        F.col("status").alias("detail"),
    )
    a = search_actors(actors, q, platform, 0.0, limit).select(
        F.lit("actor").alias("kind"), F.col("actor_id").cast("string").alias("id"), F.col("username").alias("label"),
        F.col("primary_platform").alias("detail"),
    )
    t = alerts.filter(F.lower(F.to_json(F.struct(*[F.col(c) for c in alerts.columns]))).contains(needle))
    t = t.orderBy(F.desc("detected_at"), F.asc("id")).limit(limit).select(
        F.lit("alert").alias("kind"), F.col("id").cast("string").alias("id"), F.col("type").alias("label"), F.col("severity").alias("detail"),
    )
    found = n.unionByName(a).unionByName(t)
    return found.filter(F.col("kind") == kind) if kind else found


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Critical, high and open alerts. ``alerts`` as from ``acknowledge``."""
    return alerts.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"),
        F.count(F.when(F.col("severity") == "high", 1)).alias("high"), F.count(F.when(~F.col("acknowledged"), 1)).alias("open"),
    )


def cluster_totals(clusters: DataFrame) -> DataFrame:
    by = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("medium", "high", "critical")]
    return clusters.agg(
        F.count("*").alias("clusters"), F.coalesce(F.sum("account_count"), F.lit(0)).alias("accounts"),
        F.coalesce(F.sum("estimated_reach"), F.lit(0)).alias("reach"), *by,
    )


def first_reach_order(migrations: DataFrame) -> DataFrame:
    """Earliest time per platform of each narrative, from its migrations; the origin counts from the first of them."""
    to = migrations.select("narrative_id", F.col("to_platform").alias("platform"), F.col("reached_at").alias("at"))
    start = F.col("reached_at") - F.make_dt_interval(secs=F.col("migration_time_seconds"))
    origin = migrations.select("narrative_id", F.col("from_platform").alias("platform"), start.alias("at"))
    first = to.unionByName(origin).groupBy("narrative_id", "platform").agg(F.min("at").alias("first_reached"))
    # At most one row per platform and narrative.
    order = Window.partitionBy("narrative_id").orderBy("first_reached", "platform")
    return first.withColumn("position", F.row_number().over(order))


def new_narratives(state: DataFrame, as_of: AsOf, hours: int = 24) -> DataFrame:
    recent = since("created_at", as_of, hours=hours) & (F.col("created_at") <= instant(as_of))
    return state.agg(F.count(F.when(recent, 1)).alias("new_narratives"), F.count("*").alias("narratives"))


def platforms_covered(state: DataFrame) -> DataFrame:
    return state.select(F.explode("platforms").alias("platform")).groupBy("platform").agg(F.count("*").alias("narratives"))
