"""Counters, health, lifecycle series, velocity and migrations over the sample events."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.functions.times import micros
from talewind.operators import engagement as en
from talewind.operators import metrics as me
from talewind.operators import migration as mi
from talewind.operators import rollups as ro
from talewind.operators import velocity as ve
from talewind.plans.catalog import query
from talewind.plans.tables import HALF, INGESTED, NOW, POSTS, ingested, posts, table, topic_posts
from talewind.session import new_folder

# A moment with busy minutes before it, for the queries about the last minutes.
BUSY = "2024-01-15 12:00:00"


def _metric_events(spark, sf_dir):
    """Events as metric events: the type is the metric name, the value its amount."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "ts", "event_id")


@query(
    "counter_rollup",
    """WITH g AS (
      SELECT event_type AS name, 'minute' AS grain, (epoch_us(ts) // 60000000) * 60 AS bucket, value FROM events
      UNION ALL SELECT event_type, 'hour', (epoch_us(ts) // 3600000000) * 3600, value FROM events
      UNION ALL SELECT event_type, 'day', (epoch_us(ts) // 86400000000) * 86400, value FROM events
      UNION ALL SELECT event_type, 'total', NULL, value FROM events)
    SELECT name, grain, bucket, round(sum(value), 4) AS total FROM g GROUP BY ALL""",
)
def counter_rollup(spark, sf_dir):
    found = me.counter_rollup(_metric_events(spark, sf_dir), keys=["name"])
    return found.withColumn("total", F.round("total", 4))


@query(
    "gauge_latest",
    f"""SELECT event_type AS name, arg_max(value, ts) AS value, epoch_us(max(ts)) AS us FROM events
    WHERE ts > TIMESTAMP '{BUSY}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{BUSY}' GROUP BY ALL""",
)
def gauge_latest(spark, sf_dir):
    found = me.gauge_latest(_metric_events(spark, sf_dir), BUSY, hours=6)
    return found.select("name", "value", micros("ts").alias("us"))


@query(
    "timer_recent",
    """SELECT name, value, us, rank FROM (
      SELECT event_type AS name, value, epoch_us(ts) AS us,
             row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events)
    WHERE rank <= 1000""",
)
def timer_recent(spark, sf_dir):
    found = me.timer_recent(_metric_events(spark, sf_dir), tie="event_id")
    return found.select("name", "value", micros("ts").alias("us"), F.col("rank").cast("long").alias("rank"))


@query(
    "rate_per_minute",
    f"""SELECT event_type AS name, round(sum(value) / 5, 6) AS per_minute FROM events
    WHERE epoch_us(ts) // 60000000 <= epoch_us(TIMESTAMP '{BUSY}') // 60000000
      AND epoch_us(ts) // 60000000 > epoch_us(TIMESTAMP '{BUSY}') // 60000000 - 5 GROUP BY ALL""",
)
def rate_per_minute(spark, sf_dir):
    found = me.rate_per_minute(_metric_events(spark, sf_dir), BUSY)
    return found.withColumn("per_minute", F.round("per_minute", 6))


@query(
    "hourly_counts",
    f"""WITH names AS (SELECT DISTINCT event_type AS name FROM events), o AS (SELECT unnest(range(48)) AS o),
    c AS (SELECT event_type AS name, (epoch_us(ts) // 3600000000) * 3600 AS hour, count(*) AS n FROM events GROUP BY ALL)
    SELECT n.name, -o AS hour_offset, (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600 AS hour, coalesce(c.n, 0) AS total
    FROM names n CROSS JOIN o LEFT JOIN c
      ON c.name = n.name AND c.hour = (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600""",
)
def hourly_counts(spark, sf_dir):
    events = _metric_events(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    found = me.hourly_counts(events, BUSY, 48, value="one")
    return found.withColumn("hour_offset", F.col("hour_offset").cast("long"))


@query(
    "count_for_day",
    "SELECT event_type AS name, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY ALL",
)
def count_for_day(spark, sf_dir):
    found = me.count_for_day(_metric_events(spark, sf_dir), "2024-01-15")
    return found.withColumn("total", F.round("total", 4))


HEALTH = f"""
health AS (
  SELECT platform, count(*) FILTER (family IN ('posts', 'comments', 'articles')) AS records_total,
    count(*) FILTER (family IN ('posts', 'comments', 'articles') AND ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}') AS records_today,
    count(*) FILTER (family IN ('posts', 'comments', 'articles') AND epoch_us(ts) // 60000000 <= epoch_us(TIMESTAMP '{BUSY}') // 60000000
      AND epoch_us(ts) // 60000000 > epoch_us(TIMESTAMP '{BUSY}') // 60000000 - 5) / 5.0::DOUBLE AS records_per_minute,
    count(*) FILTER (family = 'errors' AND ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}') AS errors_today,
    count(*) FILTER (family = 'pauses' AND ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}') AS pauses_today
  FROM ingested GROUP BY platform),
rated AS (
  SELECT *, CASE WHEN records_total = 0 THEN 'gray' WHEN errors_today > 10 OR records_per_minute = 0 THEN 'red'
                 WHEN errors_today > 0 OR pauses_today > 5 THEN 'yellow' ELSE 'green' END AS status FROM health)"""


@query("source_health", f"WITH {INGESTED}, {HEALTH} SELECT * FROM rated")
def source_health(spark, sf_dir):
    return me.source_health(ingested(spark, sf_dir), BUSY)


@query(
    "source_overview",
    f"""WITH {INGESTED}, {HEALTH}
    SELECT sum(records_total)::BIGINT AS total_records, sum(records_today)::BIGINT AS records_today,
           round(sum(records_per_minute), 1) AS records_per_minute,
           count(*) FILTER (status IN ('green', 'yellow')) AS active_sources, count(*) AS total_sources FROM rated""",
)
def source_overview(spark, sf_dir):
    return me.source_overview(me.source_health(ingested(spark, sf_dir), BUSY))


@query(
    "ingestion_rate",
    f"""WITH {INGESTED}, r AS (SELECT * FROM ingested WHERE family IN ('posts', 'comments', 'articles')),
    names AS (SELECT DISTINCT platform FROM r), o AS (SELECT unnest(range(24)) AS o),
    c AS (SELECT platform, (epoch_us(ts) // 3600000000) * 3600 AS hour, count(*) AS n FROM r GROUP BY ALL)
    SELECT n.platform, -o AS hour_offset, (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600 AS hour, coalesce(c.n, 0) AS total
    FROM names n CROSS JOIN o LEFT JOIN c
      ON c.platform = n.platform AND c.hour = (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600""",
)
def ingestion_rate(spark, sf_dir):
    found = me.ingestion_rate(ingested(spark, sf_dir), BUSY)
    return found.withColumn("hour_offset", F.col("hour_offset").cast("long"))


@query(
    "source_detail",
    f"""WITH {INGESTED}
    SELECT platform, count(*) FILTER (family = 'posts') AS total_posts, count(*) FILTER (family = 'comments') AS total_comments,
      count(*) FILTER (family = 'articles') AS total_articles,
      count(*) FILTER (family = 'errors' AND ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}') AS errors_today,
      round(count(*) FILTER (family IN ('posts', 'comments', 'articles') AND epoch_us(ts) // 60000000 <= epoch_us(TIMESTAMP '{BUSY}') // 60000000
        AND epoch_us(ts) // 60000000 > epoch_us(TIMESTAMP '{BUSY}') // 60000000 - 5) / 5.0::DOUBLE, 1) AS records_per_minute
    FROM ingested WHERE platform = 'p3' GROUP BY platform""",
)
def source_detail(spark, sf_dir):
    return me.source_detail(ingested(spark, sf_dir), "p3", BUSY)


STAGE_OF = {
    "click": "images.hashed", "view": "embeddings.generated", "purchase": "narratives.validated", "error": "clustering.errors",
    "signup": "clustering.noise_ratio",
}


@query(
    "pipeline_status",
    f"""WITH t AS (SELECT * FROM events WHERE ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}')
    SELECT 'image_hasher' AS stage, 'hashed_today' AS figure, round(sum(value), 6) AS value FROM t WHERE event_type = 'click' HAVING count(*) > 0
    UNION ALL SELECT 'narrative_validation', 'validated_today', round(sum(value), 6) FROM t WHERE event_type = 'purchase' HAVING count(*) > 0
    UNION ALL SELECT 'clustering', 'errors_today', round(sum(value), 6) FROM t WHERE event_type = 'error' HAVING count(*) > 0
    UNION ALL SELECT 'clustering', 'noise_ratio', round(arg_max(value, ts), 6) FROM events
      WHERE event_type = 'signup' AND ts > TIMESTAMP '{BUSY}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{BUSY}' HAVING count(*) > 0
    UNION ALL SELECT 'embedding', 'throughput_per_minute', round(sum(value) / 5, 1) FROM events
      WHERE event_type = 'view' AND epoch_us(ts) // 60000000 <= epoch_us(TIMESTAMP '{BUSY}') // 60000000
        AND epoch_us(ts) // 60000000 > epoch_us(TIMESTAMP '{BUSY}') // 60000000 - 5 HAVING count(*) > 0""",
)
def pipeline_status(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair])
    metrics = _metric_events(spark, sf_dir).select(
        F.element_at(names, F.col("name")).alias("name"),
        F.when(F.col("name") == "signup", "gauge").otherwise("counter").alias("kind"), "value", "ts",
    )
    return me.pipeline_status(metrics, BUSY).withColumn("value", F.round("value", 6))


@query(
    "platform_stats",
    f"""WITH {INGESTED}
    SELECT platform, count(*) AS total, count(*) FILTER (ts >= DATE '2024-01-15' AND ts <= TIMESTAMP '{BUSY}') AS today
    FROM ingested WHERE family IN ('posts', 'comments', 'articles') GROUP BY platform""",
)
def platform_stats(spark, sf_dir):
    return me.platform_stats(ingested(spark, sf_dir), BUSY)


# --- lifecycle and migrations -----------------------------------------------------------------------------------------

@query(
    "narrative_snapshots",
    f"""WITH {POSTS},
    b AS (SELECT narrative_id, (us // 21600000000) * 21600 AS bucket, count(*) AS content_count,
                 count(DISTINCT actor_id) AS actor_count, round(avg(value), 6) AS sentiment_avg FROM posts GROUP BY ALL)
    SELECT *, round(coalesce((content_count - lag(content_count) OVER w) / ((bucket - lag(bucket) OVER w) / 3600), 0.0), 9) AS velocity
    FROM b WINDOW w AS (PARTITION BY narrative_id ORDER BY bucket)""",
)
def narrative_snapshots(spark, sf_dir):
    found = mi.narrative_snapshots(posts(spark, sf_dir).withColumnRenamed("value", "sentiment"), 6 * 3600)
    return found.withColumn("sentiment_avg", F.round("sentiment_avg", 6)).withColumn("velocity", F.round("velocity", 9))


TIMELINE = """
timeline AS (
  SELECT narrative_id, platform, min(us) AS first_seen, count(*) AS content_count FROM posts GROUP BY ALL)"""


@query("platform_timeline", f"WITH {POSTS}, {TIMELINE} SELECT * FROM timeline")
def platform_timeline(spark, sf_dir):
    found = mi.platform_timeline(posts(spark, sf_dir))
    return found.withColumn("first_seen", micros("first_seen"))


@query(
    "detect_migrations",
    f"""WITH {POSTS}, {TIMELINE},
    o AS (SELECT narrative_id, arg_min(platform, (first_seen, platform)) AS from_platform, min(first_seen) AS start FROM timeline GROUP BY ALL),
    known AS (SELECT DISTINCT narrative_id, platform FROM posts WHERE created_at < TIMESTAMP '2024-01-02 00:00:00')
    SELECT t.narrative_id, from_platform, t.platform AS to_platform, (t.first_seen - start) // 1000000 AS migration_time_seconds,
           t.first_seen AS reached_at
    FROM timeline t JOIN o USING (narrative_id) LEFT JOIN known k ON k.narrative_id = t.narrative_id AND k.platform = t.platform
    WHERE k.platform IS NULL AND t.platform <> from_platform""",
)
def detect_migrations(spark, sf_dir):
    p = posts(spark, sf_dir)
    known = p.filter(F.col("created_at") < F.lit("2024-01-02 00:00:00").cast("timestamp")).select("narrative_id", "platform").distinct()
    found = mi.detect_migrations(mi.platform_timeline(p), known)
    return found.withColumn("reached_at", micros("reached_at"))


@query(
    "detect_migrations_of_spreading",
    f"""WITH {POSTS}, {TIMELINE},
    st AS (SELECT narrative_id, CASE WHEN max(created_at) < TIMESTAMP '2024-01-30 12:00:00' THEN 'dormant'
                                     WHEN count(*) > 105 THEN 'viral' ELSE 'growing' END AS status FROM posts GROUP BY ALL),
    o AS (SELECT narrative_id, arg_min(platform, (first_seen, platform)) AS from_platform, min(first_seen) AS start FROM timeline GROUP BY ALL)
    SELECT t.narrative_id, from_platform, t.platform AS to_platform, (t.first_seen - start) // 1000000 AS migration_time_seconds
    FROM timeline t JOIN o USING (narrative_id) JOIN st USING (narrative_id)
    WHERE t.platform <> from_platform AND status IN ('emerging', 'growing', 'viral')""",
)
def migrations_of_spreading(spark, sf_dir):
    p = posts(spark, sf_dir)
    states = p.groupBy("narrative_id").agg(F.max("created_at").alias("_last"), F.count("*").alias("_n")).select(
        "narrative_id",
        F.when(F.col("_last") < F.lit("2024-01-30 12:00:00").cast("timestamp"), "dormant")
        .when(F.col("_n") > 105, "viral").otherwise("growing").alias("status"),
    )
    return mi.detect_migrations(mi.platform_timeline(p), states=states).drop("reached_at")


# --- engagement of communities ----------------------------------------------------------------------------------------

def _community_posts(spark, sf_dir):
    """Users' platforms as communities: clicks are replies, views reposts."""
    return posts(spark, sf_dir).select(
        F.col("topic").alias("community_id"), F.col("actor_id").alias("author_id"), F.col("platform").alias("text"),
        (F.col("platform") == "click").alias("is_reply"), (F.col("platform") == "view").alias("is_repost"),
        F.hour("created_at").alias("hour"), "created_at",
    )


def _profile_sql(name: str, condition: str) -> str:
    return f"""
{name} AS (
  SELECT topic AS community_id, 1.0::DOUBLE AS avg_comment_length,
    count(*) FILTER (platform = 'click') / count(*) AS reply_ratio, count(*) FILTER (platform = 'view') / count(*) AS repost_ratio,
    count(*) FILTER (platform NOT IN ('click', 'view')) / count(*) AS original_content_ratio,
    count(DISTINCT actor_id) / count(*) AS unique_author_ratio,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM posts q WHERE q.topic = p.topic AND {condition} GROUP BY hour(created_at))) / count(*)
      AS peak_hour_concentration
  FROM posts p WHERE {condition} GROUP BY topic HAVING count(*) >= 20)"""


@query(
    "engagement_profile",
    f"""WITH {POSTS}, {_profile_sql('profile', 'true')}
    SELECT community_id, avg_comment_length, round(reply_ratio, 9) AS reply_ratio, round(repost_ratio, 9) AS repost_ratio,
      round(original_content_ratio, 9) AS original_content_ratio, round(unique_author_ratio, 9) AS unique_author_ratio,
      round(peak_hour_concentration, 9) AS peak_hour_concentration FROM profile""",
)
def engagement_profile(spark, sf_dir):
    found = en.engagement_profile(_community_posts(spark, sf_dir), "community_id")
    return found.select("community_id", *[F.round(m, 9).alias(m) for m in en.METRICS])


# A community per narrative, first half of the month against the second.
def _halves(spark, sf_dir):
    rows = posts(spark, sf_dir).select(
        F.col("narrative_id").alias("community_id"), F.col("actor_id").alias("author_id"), F.col("platform").alias("text"),
        (F.col("platform") == "click").alias("is_reply"), (F.col("platform") == "view").alias("is_repost"),
        F.hour("created_at").alias("hour"), "created_at",
    )
    cut = F.lit(HALF).cast("timestamp")
    old = en.engagement_profile(rows.filter(F.col("created_at") < cut), "community_id")
    return en.engagement_profile(rows.filter(F.col("created_at") >= cut), "community_id"), old


def _half_sql(name: str, op: str) -> str:
    c = f"created_at {op} TIMESTAMP '{HALF}'"
    return _profile_sql(name, c).replace("topic", "narrative_id")


CHANGES = """
un AS (UNPIVOT now_p ON avg_comment_length, reply_ratio, repost_ratio, original_content_ratio, unique_author_ratio,
       peak_hour_concentration INTO NAME metric VALUE v),
ub AS (UNPIVOT old_p ON avg_comment_length, reply_ratio, repost_ratio, original_content_ratio, unique_author_ratio,
       peak_hour_concentration INTO NAME metric VALUE v),
changes AS (
  SELECT un.community_id, un.metric, ub.v AS old_v, un.v AS new_v, abs(un.v - ub.v) / ub.v AS change
  FROM un JOIN ub ON un.community_id = ub.community_id AND un.metric = ub.metric
  WHERE ub.v > 0 AND abs(un.v - ub.v) / ub.v > 0.3)"""


@query(
    "metric_changes",
    f"""WITH {POSTS}, {_half_sql('now_p', '>=')}, {_half_sql('old_p', '<')}, {CHANGES}
    SELECT community_id, metric, round(old_v, 4) AS baseline, round(new_v, 4) AS current, round(change * 100, 1) AS change_pct FROM changes""",
)
def metric_changes(spark, sf_dir):
    return en.metric_changes(*_halves(spark, sf_dir), "community_id")


@query(
    "engagement_shift",
    f"""WITH {POSTS}, {_half_sql('now_p', '>=')}, {_half_sql('old_p', '<')}, {CHANGES}
    SELECT community_id, 'engagement_shift' AS type, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity,
           count(*) AS shift_count FROM changes GROUP BY community_id""",
)
def engagement_shift(spark, sf_dir):
    return en.engagement_shift(*_halves(spark, sf_dir), "community_id").drop("shifts")


# --- snapshots and velocity -------------------------------------------------------------------------------------------

SCHEDULE = """
schedule AS (
  SELECT content_id, platform, i AS interval_s, us + i::BIGINT * 1000000 AS poll_us
  FROM posts CROSS JOIN (SELECT unnest([300, 900, 3600, 21600, 86400, 259200]) AS i))"""


@query("snapshot_schedule", f"WITH {POSTS}, {SCHEDULE} SELECT content_id, platform, interval_s::BIGINT AS interval_s, poll_us FROM schedule")
def snapshot_schedule(spark, sf_dir):
    found = ve.snapshot_schedule(posts(spark, sf_dir))
    return found.select("content_id", "platform", F.col("interval").cast("long").alias("interval_s"), micros("poll_at").alias("poll_us"))


@query(
    "due_polls",
    f"""WITH {POSTS}, {SCHEDULE},
    captured AS (SELECT content_id, interval_s FROM schedule WHERE poll_us < epoch_us(TIMESTAMP '{BUSY}'))
    SELECT s.content_id, s.interval_s::BIGINT AS interval_s, s.poll_us FROM schedule s
    LEFT JOIN captured c ON c.content_id = s.content_id AND c.interval_s = s.interval_s
    WHERE c.content_id IS NULL AND s.poll_us <= epoch_us(TIMESTAMP '2024-01-16 12:00:00') ORDER BY s.poll_us, s.content_id, s.interval_s LIMIT 100""",
)
def due_polls(spark, sf_dir):
    schedule = ve.snapshot_schedule(posts(spark, sf_dir))
    captured = schedule.filter(F.col("poll_at") < F.lit(BUSY).cast("timestamp"))
    found = ve.due_polls(schedule, captured, "2024-01-16 12:00:00")
    return found.select("content_id", F.col("interval").cast("long").alias("interval_s"), micros("poll_at").alias("poll_us"))


def _snapshots(spark, sf_dir):
    """A user's events as snapshots of one record: the value is the like counter, the narrative the reply counter."""
    return posts(spark, sf_dir).select(
        F.col("actor_id").alias("content_id"), F.col("created_at").alias("ts"), F.col("value").alias("likes"),
        F.col("narrative_id").alias("replies"),
    )


VELOCITY = """
s AS (SELECT actor_id AS content_id, us, value AS likes, narrative_id AS replies FROM posts),
l1 AS (SELECT *, lag(us) OVER w AS us1, lag(likes) OVER w AS likes1, lag(replies) OVER w AS replies1 FROM s
       WINDOW w AS (PARTITION BY content_id ORDER BY us, likes, replies)),
v AS (SELECT *, (us - us1) / 3600000000 AS hours, CASE WHEN us <> us1 THEN (likes - likes1) / ((us - us1) / 3600000000) END AS lph,
             CASE WHEN us <> us1 THEN (replies - replies1) / ((us - us1) / 3600000000) END AS rph FROM l1),
velocity AS (SELECT content_id, us, lph, rph, (lph - lag(lph) OVER (PARTITION BY content_id ORDER BY us, likes, replies)) / hours AS acc FROM v)"""


@query(
    "engagement_velocity",
    f"""WITH {POSTS}, {VELOCITY}
    SELECT content_id, us, round(lph, 6) AS likes_per_hour, round(rph, 6) AS replies_per_hour, round(acc, 6) AS acceleration
    FROM velocity WHERE lph IS NOT NULL""",
)
def engagement_velocity(spark, sf_dir):
    found = ve.engagement_velocity(_snapshots(spark, sf_dir))
    return found.select(
        "content_id", micros("ts").alias("us"), *[F.round(c, 6).alias(c) for c in ("likes_per_hour", "replies_per_hour", "acceleration")]
    )


@query(
    "velocity_anomaly",
    f"""WITH {POSTS}, {VELOCITY}
    SELECT content_id, us, round(lph, 6) AS likes_per_hour, CASE WHEN lph > 2000 THEN 'high' ELSE 'medium' END AS severity
    FROM velocity WHERE lph > 500""",
)
def velocity_anomaly(spark, sf_dir):
    found = ve.velocity_anomaly(ve.engagement_velocity(_snapshots(spark, sf_dir)))
    return found.select("content_id", micros("ts").alias("us"), F.round("likes_per_hour", 6).alias("likes_per_hour"), "severity")


@query(
    "latest_velocity",
    f"""WITH {POSTS}, {VELOCITY}
    SELECT content_id, us, round(lph, 6) AS likes_per_hour FROM velocity WHERE lph IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY us DESC) = 1""",
)
def latest_velocity(spark, sf_dir):
    found = ve.latest_velocity(ve.engagement_velocity(_snapshots(spark, sf_dir)))
    return found.select("content_id", micros("ts").alias("us"), F.round("likes_per_hour", 6).alias("likes_per_hour"))


@query(
    "edit_wars",
    f"""WITH {POSTS},
    c AS (SELECT platform AS title, (us // 3600000000) * 3600 AS hour, content_id AS edit_id, value > 30 AS is_revert,
            count(*) OVER w AS hourly_edits, count(*) FILTER (value > 30) OVER w AS hourly_reverts
          FROM posts WINDOW w AS (PARTITION BY platform, us // 3600000000 ORDER BY us, content_id ROWS UNBOUNDED PRECEDING))
    SELECT title, hour, edit_id, hourly_edits, hourly_reverts FROM c WHERE is_revert AND hourly_edits >= 5 AND hourly_reverts >= 2""",
)
def edit_wars(spark, sf_dir):
    # Platforms as pages, large values as reverts; an hour of sample events is quieter than an edit war.
    edits = posts(spark, sf_dir).select(
        F.col("platform").alias("title"), F.col("content_id").alias("edit_id"), F.col("created_at").alias("ts"),
        (F.col("value") > 30).alias("is_revert"),
    )
    return ve.edit_wars(edits, 5, 2).drop("ts")


# --- the dashboards from a roll-up ------------------------------------------------------------------------------------

def _stored(spark, sf_dir):
    """A roll-up of all ingestion counters in a folder of its own: rows of the last day, totals."""
    path = new_folder(spark)
    ro.write_days(ingested(spark, sf_dir), path, ["platform", "family"])
    return ro.recent(spark, path, BUSY), ro.totals(spark, path)


# Minutes are the least that a roll-up knows: the running one counts as a whole.
BY_MINUTE = f"ts < TIMESTAMP '{BUSY}' + INTERVAL 1 MINUTE"


@query("rollup_source_health", f"WITH {INGESTED}, {HEALTH} SELECT * FROM rated".replace(f"ts <= TIMESTAMP '{BUSY}'", BY_MINUTE))
def rollup_source_health(spark, sf_dir):
    rows, totals = _stored(spark, sf_dir)
    return me.source_health(rows, BUSY, totals)


@query(
    "rollup_ingestion_rate",
    f"""WITH {INGESTED}, r AS (SELECT * FROM ingested WHERE family IN ('posts', 'comments', 'articles')),
    names AS (SELECT DISTINCT platform FROM r), o AS (SELECT unnest(range(24)) AS o),
    c AS (SELECT platform, (epoch_us(ts) // 3600000000) * 3600 AS hour, count(*) AS n FROM r WHERE {BY_MINUTE} GROUP BY ALL)
    SELECT n.platform, -o AS hour_offset, (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600 AS hour, coalesce(c.n, 0) AS total
    FROM names n CROSS JOIN o LEFT JOIN c
      ON c.platform = n.platform AND c.hour = (epoch_us(TIMESTAMP '{BUSY}') // 3600000000 - o) * 3600""",
)
def rollup_ingestion_rate(spark, sf_dir):
    rows, totals = _stored(spark, sf_dir)
    found = me.ingestion_rate(rows, BUSY, totals=totals)
    return found.withColumn("hour_offset", F.col("hour_offset").cast("long"))


@query(
    "rollup_source_detail",
    f"""WITH {INGESTED}
    SELECT platform, count(*) FILTER (family = 'posts') AS total_posts, count(*) FILTER (family = 'comments') AS total_comments,
      count(*) FILTER (family = 'articles') AS total_articles,
      count(*) FILTER (family = 'errors' AND ts >= DATE '2024-01-15' AND {BY_MINUTE}) AS errors_today,
      round(count(*) FILTER (family IN ('posts', 'comments', 'articles') AND {BY_MINUTE}
        AND epoch_us(ts) // 60000000 > epoch_us(TIMESTAMP '{BUSY}') // 60000000 - 5) / 5.0::DOUBLE, 1) AS records_per_minute
    FROM ingested WHERE platform = 'p3' GROUP BY platform""",
)
def rollup_source_detail(spark, sf_dir):
    rows, totals = _stored(spark, sf_dir)
    return me.source_detail(rows, "p3", BUSY, totals)
