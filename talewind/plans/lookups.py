"""User-level queries over results derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.functions.times import micros
from talewind.operators import briefing as br
from talewind.operators import coordination as co
from talewind.operators import migration as mi
from talewind.operators import search as se
from talewind.operators.graph_build import counted_edges
from talewind.operators.graph_query import community_summary
from talewind.operators.rank import top_bridges
from talewind.plans.catalog import query
from talewind.plans.forecasts import ALL_PREDICTIONS, STATE, matches, narrative_state
from talewind.plans.graph import SCORED, scored_actors
from talewind.plans.series import TIMELINE
from talewind.plans.signals import CLUSTERS, SIGNALS, STARS, SWARM_AT, _clusters, _signal_tables
from talewind.plans.tables import (
    ACCOUNTS, INGESTED, MERGED_EDGES, NOW, PAIR_WEIGHTS, POSTS, USER_ACTORS, ingested, interactions, posts, table,
)
from talewind.session import cut_lineage
from talewind.operators import predict as pr


# --- content and narratives -----------------------------------------------------------------------------------------------

def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.col("source").alias("platform"), F.col("lang").alias("content_type"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"), "text",
    )


@query(
    "search_content",
    """SELECT doc_id AS content_id, source AS platform, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS excerpt_md5
    FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' ORDER BY doc_id DESC LIMIT 50 OFFSET 20""",
)
def search_content(spark, sf_dir):
    page = se.search_content(_documents(spark, sf_dir), "The", content_type="en", limit=50, offset=20)
    return page.select("content_id", "platform", F.md5("text").alias("excerpt_md5"))


@query("search_total", "SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND doc_id * 60 >= 6000")
def search_total(spark, sf_dir):
    return se.search_total(_documents(spark, sf_dir), "the", content_type="en", after="1970-01-01 01:40:00")


@query("list_narratives", f"WITH {STATE} SELECT narrative_id, status FROM state WHERE status = 'growing' AND narrative_id > '2' ORDER BY narrative_id LIMIT 10")
def list_narratives(spark, sf_dir):
    return se.list_narratives(narrative_state(spark, sf_dir), "growing", 10, after="2").select("narrative_id", "status")


SNAPS = """
b AS (SELECT CAST(narrative_id AS VARCHAR) AS narrative_id, (us // 86400000000) * 86400 AS bucket, count(*) AS content_count, count(DISTINCT actor_id) AS actor_count FROM posts GROUP BY ALL),
snaps AS (SELECT *, coalesce((content_count - lag(content_count) OVER w) / ((bucket - lag(bucket) OVER w) / 3600), 0.0) AS velocity FROM b WINDOW w AS (PARTITION BY narrative_id ORDER BY bucket))"""


def _snapshots(spark, sf_dir):
    rows = posts(spark, sf_dir).withColumn("narrative_id", F.col("narrative_id").cast("string")).withColumnRenamed("value", "sentiment")
    return mi.narrative_snapshots(rows, 86400)


@query("narrative_velocity", f"WITH {POSTS}, {SNAPS} SELECT narrative_id, bucket, content_count, actor_count, round(velocity, 9) AS velocity FROM snaps WHERE narrative_id = '17'")
def narrative_velocity(spark, sf_dir):
    return se.narrative_velocity(_snapshots(spark, sf_dir), "17").withColumn("velocity", F.round("velocity", 9))


@query(
    "narrative_detail",
    f"""WITH {STATE}, {SNAPS}
    SELECT s.narrative_id, status, summary, (SELECT round(arg_max(velocity, bucket), 9) FROM snaps x WHERE x.narrative_id = '17') AS current_velocity,
      (SELECT round(max(velocity), 9) FROM snaps x WHERE x.narrative_id = '17') AS max_velocity FROM state s WHERE s.narrative_id = '17'""",
)
def narrative_detail(spark, sf_dir):
    state = narrative_state(spark, sf_dir).drop("content_count")
    found = se.narrative_detail(state, _snapshots(spark, sf_dir), "17")
    return found.select("narrative_id", "status", "summary", F.round("current_velocity", 9).alias("current_velocity"), F.round("max_velocity", 9).alias("max_velocity"))


@query("narrative_predictions", f"WITH {ALL_PREDICTIONS} SELECT narrative_id, prediction_type, confidence FROM preds WHERE narrative_id = '12'")
def narrative_predictions(spark, sf_dir):
    state, found = matches(spark, sf_dir)
    return se.narrative_predictions(pr.predictions(found, state), "12").select("narrative_id", "prediction_type", "confidence")


MIGRATIONS = TIMELINE + """,
mo AS (SELECT narrative_id, arg_min(platform, (first_seen, platform)) AS from_platform, min(first_seen) AS start FROM timeline GROUP BY ALL),
migrations AS (SELECT narrative_id, from_platform, platform AS to_platform, (first_seen - start) // 1000000 AS migration_time_seconds, first_seen AS reached_us
               FROM timeline JOIN mo USING (narrative_id) WHERE platform <> from_platform)"""


def _migrations(spark, sf_dir):
    found = mi.detect_migrations(mi.platform_timeline(posts(spark, sf_dir)))
    return found.withColumn("detected_at", F.col("reached_at")).withColumn("id", F.concat_ws("/", "narrative_id", "to_platform"))


@query("narrative_migrations", f"WITH {POSTS}, {MIGRATIONS} SELECT narrative_id, from_platform, to_platform, migration_time_seconds, reached_us FROM migrations WHERE narrative_id = 17")
def narrative_migrations(spark, sf_dir):
    found = se.narrative_migrations(_migrations(spark, sf_dir), 17)
    return found.select("narrative_id", "from_platform", "to_platform", "migration_time_seconds", micros("reached_at").alias("reached_us"))


@query(
    "first_reach_order",
    f"""WITH {POSTS}, {MIGRATIONS},
    r AS (SELECT narrative_id, to_platform AS platform, reached_us AS us FROM migrations
          UNION ALL SELECT narrative_id, from_platform, reached_us - migration_time_seconds * 1000000 FROM migrations),
    f AS (SELECT narrative_id, platform, min(us) AS first_us FROM r GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY first_us, platform) AS position FROM f""",
)
def first_reach_order(spark, sf_dir):
    found = se.first_reach_order(_migrations(spark, sf_dir))
    return found.select("narrative_id", "platform", micros("first_reached").alias("first_us"), F.col("position").cast("long").alias("position"))


@query(
    "new_narratives",
    f"WITH {STATE} SELECT count(*) FILTER (created_at > TIMESTAMP '2024-01-01 08:00:00' - INTERVAL 6 HOUR AND created_at <= TIMESTAMP '2024-01-01 08:00:00') AS new_narratives, count(*) AS narratives FROM state",
)
def new_narratives(spark, sf_dir):
    return se.new_narratives(narrative_state(spark, sf_dir), "2024-01-01 08:00:00", 6)


@query("platforms_covered", f"WITH {STATE}, u AS (SELECT unnest(platforms) AS platform FROM state) SELECT platform, count(*) AS narratives FROM u GROUP BY ALL")
def platforms_covered(spark, sf_dir):
    return se.platforms_covered(narrative_state(spark, sf_dir))


# --- clusters, signals, alerts --------------------------------------------------------------------------------------------

@query(
    "list_clusters",
    f"WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS} SELECT cluster_id, confidence, account_count FROM clusters WHERE confidence >= 0.4 ORDER BY confidence DESC, cluster_id LIMIT 50",
)
def list_clusters(spark, sf_dir):
    return se.list_clusters(_clusters(spark, sf_dir)[0], 0.4).select("cluster_id", "confidence", "account_count")


@query(
    "cluster_by_id",
    f"WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS} SELECT cluster_id, signal_count FROM clusters WHERE cluster_id = left(sha256('cluster|0'), 32)",
)
def cluster_by_id(spark, sf_dir):
    from talewind.functions.ids import row_key

    wanted = F.col("cluster_id") == row_key(F.lit("cluster"), F.lit(0))
    return _clusters(spark, sf_dir)[0].filter(wanted).select("cluster_id", "signal_count")


@query(
    "cluster_totals",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}
    SELECT count(*) AS clusters, coalesce(sum(account_count), 0)::BIGINT AS accounts, count(*) FILTER (severity = 'medium') AS medium,
      count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM clusters""",
)
def cluster_totals(spark, sf_dir):
    return se.cluster_totals(_clusters(spark, sf_dir)[0]).drop("reach")


# Star signals of the interactions (all at the same time) and swarm signals of the users.
def _all_signals(spark, sf_dir, edges=None):
    stars = co.star_topology(counted_edges(interactions(spark, sf_dir)) if edges is None else edges)
    star_signals = co.as_signals(stars, "star_topology", NOW, ["hub"], key=["hub"])
    swarms, _ = _signal_tables(spark, sf_dir)
    return star_signals.unionByName(swarms)


ALL_SIGNALS = f"""{MERGED_EDGES}, {STARS}, {POSTS}, {USER_ACTORS}, {SIGNALS},
all_signals AS (
  SELECT left(sha256('star_topology|' || hub), 32) AS signal_id, 'star_topology' AS type, NULL AS narrative_id, confidence, TIMESTAMP '{NOW}' AS detected_at FROM stars
  UNION ALL SELECT signal_id, type, narrative_id, confidence, detected_at FROM signals)"""


@query(
    "list_signals",
    f"""WITH {ALL_SIGNALS} SELECT signal_id, type, round(confidence, 9) AS confidence FROM all_signals
    WHERE detected_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND type = 'star_topology' ORDER BY detected_at DESC, signal_id LIMIT 30""",
)
def list_signals(spark, sf_dir):
    found = se.list_signals(_all_signals(spark, sf_dir), NOW, 24, "star_topology", 30)
    return found.select("signal_id", "type", F.round("confidence", 9).alias("confidence"))


def _alerts(spark, sf_dir, edges=None):
    moved = _migrations(spark, sf_dir)
    behavioral = posts(spark, sf_dir).groupBy("topic").agg(F.max("created_at").alias("detected_at"), F.count("*").alias("_n")).select(
        F.concat(F.lit("b"), "topic").alias("id"), F.lit("engagement_shift").alias("type"), F.col("topic").alias("community_id"),
        F.when(F.col("_n") > 1000, "high").otherwise("medium").alias("severity"), "detected_at",
    )
    return se.all_alerts(_all_signals(spark, sf_dir, edges), behavioral, moved)


ALERTS = f"""{ALL_SIGNALS}, {MIGRATIONS},
alerts AS (
  SELECT signal_id AS id, 'coordination' AS category, type, CASE WHEN confidence > 0.9 THEN 'critical' WHEN confidence > 0.75 THEN 'high' ELSE 'medium' END AS severity, detected_at FROM all_signals
  UNION ALL SELECT 'b' || topic, 'behavioral', 'engagement_shift', CASE WHEN count(*) > 1000 THEN 'high' ELSE 'medium' END, max(created_at) FROM posts GROUP BY topic
  UNION ALL SELECT narrative_id || '/' || to_platform, 'migration', 'migration', 'high', make_timestamp(reached_us) FROM migrations)"""


@query(
    "alert_feed",
    f"""WITH {ALERTS} SELECT id, category, type, severity FROM alerts WHERE detected_at > TIMESTAMP '{SWARM_AT}' - INTERVAL 36 HOUR AND detected_at <= TIMESTAMP '{SWARM_AT}' AND severity = 'high'
    ORDER BY detected_at DESC, id LIMIT 100""",
)
def alert_feed(spark, sf_dir):
    return se.alert_feed(_alerts(spark, sf_dir), SWARM_AT, 36, "high", 100).select("id", "category", "type", "severity")


ACKED = f"""{ALERTS},
acks AS (SELECT id, 'ann' AS client FROM alerts WHERE category = 'migration'),
acked AS (SELECT a.*, client AS acknowledged_by, client IS NOT NULL AS acknowledged FROM alerts a LEFT JOIN acks USING (id))"""


def _acknowledged(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    moved = alerts.filter(F.col("category") == "migration").select("id", "detected_at")
    acks = moved.select("id", F.lit("ann").alias("client"), F.col("detected_at").alias("at")).unionByName(
        moved.select("id", F.lit("bob").alias("client"), (F.col("detected_at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    )
    return se.acknowledge(alerts, acks)


@query("acknowledge", f"WITH {ACKED} SELECT id, category, acknowledged_by, acknowledged FROM acked")
def acknowledge(spark, sf_dir):
    return _acknowledged(spark, sf_dir).select("id", "category", "acknowledged_by", "acknowledged")


@query(
    "alert_counts",
    f"""WITH {ACKED} SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (NOT acknowledged) AS open FROM acked""",
)
def alert_counts(spark, sf_dir):
    return se.alert_counts(_acknowledged(spark, sf_dir))


# --- network ----------------------------------------------------------------------------------------------------------------

@query(
    "list_communities",
    f"WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED} SELECT community_id, count(*) AS member_count FROM scored GROUP BY ALL ORDER BY member_count DESC, community_id LIMIT 10",
)
def list_communities(spark, sf_dir):
    return se.list_communities(community_summary(scored_actors(spark, sf_dir)), 10).select("community_id", "member_count")


@query("list_bridges", f"WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED} SELECT actor_id, bridge_score FROM scored WHERE bridge_score > 0.3 ORDER BY bridge_score DESC, actor_id LIMIT 50")
def list_bridges(spark, sf_dir):
    return se.list_bridges(top_bridges(scored_actors(spark, sf_dir))).select("actor_id", "bridge_score")


@query(
    "search_actors",
    f"""WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED} SELECT actor_id, username, influence_score FROM scored
    WHERE contains(lower(username), 'supplier') AND influence_score >= 0.3 ORDER BY influence_score DESC, actor_id LIMIT 50""",
)
def search_actors(spark, sf_dir):
    return se.search_actors(scored_actors(spark, sf_dir), "SUPPLIER", min_influence=0.3).select("actor_id", "username", "influence_score")


@query(
    "global_search",
    f"""WITH {ALERTS}, {ACCOUNTS}, {SCORED},
    a AS (SELECT 'actor' AS kind, actor_id AS id, username AS label, primary_platform AS detail FROM scored WHERE contains(lower(username), '00000001') ORDER BY influence_score DESC, actor_id LIMIT 50),
    t AS (SELECT 'alert' AS kind, id, type AS label, severity AS detail FROM alerts
          WHERE contains(id, '00000001') ORDER BY detected_at DESC, id LIMIT 50)
    SELECT * FROM a UNION ALL SELECT * FROM t""",
)
def global_search(spark, sf_dir):
    # No narrative of the sample carries this number.
    edges = cut_lineage(counted_edges(interactions(spark, sf_dir)))
    state = narrative_state(spark, sf_dir).drop("created_at", "velocity_curve", "duration_hours", "coordination_score")
    return se.global_search("00000001", state, scored_actors(spark, sf_dir, edges), _alerts(spark, sf_dir, edges))


# --- briefings --------------------------------------------------------------------------------------------------------------

def _snapshot(spark, sf_dir):
    state = narrative_state(spark, sf_dir).select("narrative_id", "summary", "content_count")
    alerts = _alerts(spark, sf_dir).filter(F.col("category") == "behavioral").select("id", "type", "severity", "detected_at")
    return br.briefing_snapshot(state, _clusters(spark, sf_dir)[0], _migrations(spark, sf_dir), alerts, ingested(spark, sf_dir), SWARM_AT, 36)


@query(
    "briefing_snapshot",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}, {MIGRATIONS}, {INGESTED},
    n AS (SELECT 'narratives' AS section, row_number() OVER (ORDER BY count(*) DESC, CAST(narrative_id AS VARCHAR)) AS position, CAST(narrative_id AS VARCHAR) AS key FROM posts GROUP BY narrative_id QUALIFY position <= 10),
    m AS (SELECT narrative_id, to_platform, make_timestamp(reached_us) AS ts FROM migrations WHERE make_timestamp(reached_us) > TIMESTAMP '{SWARM_AT}' - INTERVAL 36 HOUR AND make_timestamp(reached_us) <= TIMESTAMP '{SWARM_AT}'
          ORDER BY ts DESC, narrative_id, to_platform LIMIT 50),
    b AS (SELECT 'b' || topic AS key, max(created_at) AS ts FROM posts GROUP BY topic)
    SELECT section, position::INT AS position, key FROM n UNION ALL SELECT 'coordination_clusters', NULL, cluster_id FROM clusters
    UNION ALL SELECT 'migration_events', NULL, CAST(narrative_id AS VARCHAR) FROM m
    UNION ALL SELECT 'behavioral_alerts', NULL, key FROM b WHERE ts > TIMESTAMP '{SWARM_AT}' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '{SWARM_AT}'
    UNION ALL SELECT DISTINCT 'platform_stats', NULL, platform FROM ingested WHERE family IN ('posts', 'comments', 'articles')""",
)
def briefing_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir).select("section", "position", "key")


def _briefings(spark, sf_dir):
    """A briefing header per day and type of the sample events."""
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy(day.alias("_d"), F.col("event_type").alias("type")).agg(F.count("*").alias("_n")).select(
        F.concat_ws("/", "type", F.col("_d").cast("string")).alias("id"), "type", F.col("_d").cast("timestamp").alias("generated_at"),
        (F.col("_d").cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("period_start"), F.col("_d").cast("timestamp").alias("period_end"), F.col("_n").alias("body"),
    )


BRIEFINGS = "briefings AS (SELECT event_type || '/' || CAST(ts AS DATE) AS id, event_type AS type, CAST(ts AS DATE) AS d, count(*) AS body FROM events GROUP BY ALL)"


@query("list_briefings", f"WITH {BRIEFINGS} SELECT id, type, d FROM briefings ORDER BY d DESC, id LIMIT 20")
def list_briefings(spark, sf_dir):
    return se_list(br.list_briefings(_briefings(spark, sf_dir)))


def se_list(df):
    return df.select("id", "type", F.to_date("generated_at").alias("d"))


@query("latest_briefing", f"WITH {BRIEFINGS} SELECT arg_max(id, d) AS id, type, max(d) AS d, arg_max(body, d) AS body FROM briefings GROUP BY type")
def latest_briefing(spark, sf_dir):
    return br.latest_briefing(_briefings(spark, sf_dir)).select("id", "type", F.to_date("generated_at").alias("d"), "body")


@query("briefing_by_id", f"WITH {BRIEFINGS} SELECT id, body FROM briefings WHERE id = 'view/2024-01-10'")
def briefing_by_id(spark, sf_dir):
    return br.briefing(_briefings(spark, sf_dir), "view/2024-01-10").select("id", "body")
