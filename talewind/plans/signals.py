"""Coordination signals over the sample events and interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.operators import coordination as co
from talewind.operators.components import cluster_narratives, cluster_signals, coordination_clusters
from talewind.operators.graph_build import counted_edges
from talewind.plans.catalog import query
from talewind.plans.tables import (
    ACCOUNTS, MERGED_EDGES, NOW, PAIR_WEIGHTS, POSTS, USER_ACTORS, accounts, interactions, pair_weights, posts, topic_posts,
    user_actors,
)

# Sample authors are sparse: an hour and three authors stand for two minutes and ten.
WINDOW, AUTHORS = 3600, 3

TOPIC_WINDOWS = """
tp AS (SELECT content_id, us, actor_id, topic AS narrative_id FROM posts),
windows AS (
  SELECT a.narrative_id, a.us AS window_end, count(DISTINCT b.actor_id) AS authors
  FROM (SELECT DISTINCT narrative_id, us FROM tp) a
  JOIN tp b ON a.narrative_id = b.narrative_id AND b.us BETWEEN a.us - 3600000000 AND a.us
  GROUP BY ALL HAVING count(DISTINCT b.actor_id) >= 3)"""


@query("burst_windows", f"WITH {POSTS}, {TOPIC_WINDOWS} SELECT narrative_id, window_end, authors FROM windows")
def burst_windows(spark, sf_dir):
    found = co.burst_windows(topic_posts(spark, sf_dir), WINDOW, AUTHORS)
    return found.select("narrative_id", "window_end", F.col("authors").cast("long").alias("authors"))


PEAKS = TOPIC_WINDOWS + """,
peaks AS (
  SELECT narrative_id, window_end, authors FROM windows
  QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY authors DESC, window_end) = 1),
members AS (
  SELECT DISTINCT p.narrative_id, p.window_end, tp.actor_id
  FROM peaks p JOIN tp ON tp.narrative_id = p.narrative_id AND tp.us BETWEEN p.window_end - 3600000000 AND p.window_end)"""


@query(
    "temporal_burst",
    f"""WITH {PAIR_WEIGHTS}, {TOPIC_WINDOWS},
    members AS (SELECT DISTINCT w.narrative_id, w.window_end, tp.actor_id FROM windows w
                JOIN tp ON tp.narrative_id = w.narrative_id AND tp.us BETWEEN w.window_end - 3600000000 AND w.window_end),
    und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pairs WHERE src <> dst),
    met AS (
      SELECT m.narrative_id, m.window_end, count(*) AS n FROM members m JOIN members o
      ON o.narrative_id = m.narrative_id AND o.window_end = m.window_end AND m.actor_id < o.actor_id
      JOIN und ON und.a = m.actor_id AND und.b = o.actor_id GROUP BY ALL),
    scored AS (
      SELECT w.*, coalesce(n, 0) / (authors * (authors - 1) / 2) AS density
      FROM windows w LEFT JOIN met l ON w.narrative_id = l.narrative_id AND w.window_end = l.window_end)
    SELECT narrative_id, window_end, authors, round(density, 9) AS density,
           round(least(0.95, 0.5 + (authors - 3) * 0.05), 9)::DOUBLE AS confidence
    FROM scored WHERE density < 0.1
    QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY authors DESC, window_end) = 1""",
)
def temporal_burst(spark, sf_dir):
    found = co.temporal_burst(topic_posts(spark, sf_dir), pair_weights(spark, sf_dir), WINDOW, AUTHORS)
    return found.select(
        "narrative_id", "window_end", F.col("authors").cast("long").alias("authors"), F.round("density", 9).alias("density"), F.round("confidence", 9).alias("confidence")
    )


@query("burst_members", f"WITH {POSTS}, {PEAKS} SELECT narrative_id, window_end, actor_id FROM members")
def burst_members(spark, sf_dir):
    p = topic_posts(spark, sf_dir)
    return co.burst_members(p, co.burst_peaks(co.burst_windows(p, WINDOW, AUTHORS)), WINDOW)


@query(
    "connection_density",
    f"""WITH {PAIR_WEIGHTS},
    members AS (SELECT DISTINCT topic, actor_id FROM posts),
    und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pairs),
    met AS (SELECT m.topic, count(*) AS n FROM members m JOIN und ON und.a = m.actor_id
               JOIN members o ON o.topic = m.topic AND o.actor_id = und.b GROUP BY ALL),
    sized AS (SELECT topic, count(*) AS accounts FROM members GROUP BY ALL)
    SELECT topic, accounts, coalesce(n, 0) AS linked_pairs,
           round(coalesce(n, 0) / (accounts * (accounts - 1) / 2), 9) AS density
    FROM sized LEFT JOIN met USING (topic)""",
)
def connection_density(spark, sf_dir):
    members = posts(spark, sf_dir).select("topic", "actor_id").distinct()
    found = co.connection_density(members, pair_weights(spark, sf_dir), ["topic"])
    return found.withColumn("density", F.round("density", 9))


HISTORY = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, content_id DESC) - 1 AS rank FROM posts),
history AS (SELECT * FROM ranked WHERE rank BETWEEN 1 AND 100),
g AS (SELECT actor_id, (us - lag(us) OVER (PARTITION BY actor_id ORDER BY us)) / 1000000.0::DOUBLE AS gap FROM history),
stats AS (
  SELECT actor_id, count(*) AS posts, count(gap) FILTER (gap > 0) AS gaps, avg(gap) FILTER (gap > 0) AS mean_gap,
         stddev_pop(gap) FILTER (gap > 0) AS dev
  FROM g GROUP BY actor_id)"""


@query(
    "posting_intervals",
    f"""WITH {POSTS}, {HISTORY}
    SELECT actor_id, posts, gaps, round(mean_gap, 3) AS mean_gap, round(dev / mean_gap, 6) AS cv FROM stats WHERE posts > 1""",
)
def posting_intervals(spark, sf_dir):
    found = co.posting_intervals(co.recent_history(posts(spark, sf_dir)))
    return found.select("actor_id", "posts", "gaps", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 6).alias("cv"))


@query(
    "posting_regularity",
    f"""WITH {POSTS}, {HISTORY}
    SELECT actor_id, gaps, round(dev / mean_gap, 4) AS cv, round(mean_gap, 1) AS mean_gap,
           round(greatest(0.0, least(1.0, 0.9 - dev / mean_gap * 2)), 6)::DOUBLE AS confidence
    FROM stats WHERE posts >= 20 AND gaps >= 5 AND dev / mean_gap < 0.95 AND mean_gap < 86400""",
)
def posting_regularity(spark, sf_dir):
    # Sample gaps are near exponential (ratio close to 1), so the bounds are wider than the defaults.
    found = co.posting_regularity(posts(spark, sf_dir), max_cv=0.95, max_mean=86400)
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    "narrative_entropy",
    f"""WITH {POSTS}, {HISTORY},
    c AS (SELECT actor_id, topic, count(*) AS n FROM history GROUP BY ALL),
    t AS (SELECT actor_id, count(*) AS narratives, sum(n)::BIGINT AS posts FROM c GROUP BY ALL)
    SELECT actor_id, narratives, t.posts, round(-sum(n / t.posts * log2(n / t.posts)) / log2(narratives), 6) AS entropy
    FROM c JOIN t USING (actor_id) JOIN stats s USING (actor_id)
    WHERE narratives >= 3 AND t.posts >= 20 AND s.gaps >= 5 GROUP BY actor_id, narratives, t.posts""",
)
def narrative_entropy(spark, sf_dir):
    found = co.narrative_entropy(topic_posts(spark, sf_dir))
    return found.withColumn("entropy", F.round("entropy", 6))


@query(
    "content_diversity",
    f"""WITH {POSTS}, {HISTORY},
    c AS (SELECT actor_id, topic, count(*) AS n FROM history GROUP BY ALL),
    t AS (SELECT actor_id, count(*) AS narratives, sum(n)::BIGINT AS posts FROM c GROUP BY ALL),
    e AS (SELECT actor_id, narratives, t.posts, -sum(n / t.posts * log2(n / t.posts)) / log2(narratives) AS h
          FROM c JOIN t USING (actor_id) JOIN stats s USING (actor_id)
          WHERE narratives >= 3 AND t.posts >= 20 AND s.gaps >= 5 GROUP BY actor_id, narratives, t.posts)
    SELECT actor_id, narratives, posts, round(h, 4) AS entropy, round(0.7 - h, 3) AS confidence FROM e WHERE h < 0.97""",
)
def content_diversity(spark, sf_dir):
    return co.content_diversity(topic_posts(spark, sf_dir), max_entropy=0.97)


SWARM_AT = "2024-01-03 00:00:00"


@query(
    "fresh_account_swarm",
    f"""WITH {POSTS}, {USER_ACTORS},
    fresh AS (SELECT actor_id FROM actors WHERE first_seen > TIMESTAMP '{SWARM_AT}' - INTERVAL 7 DAY
              AND first_seen <= TIMESTAMP '{SWARM_AT}' AND content_count >= 3)
    SELECT narrative_id, count(DISTINCT actor_id) AS accounts,
           round(least(0.90, 0.5 + (count(DISTINCT actor_id) - 5) * 0.05), 9)::DOUBLE AS confidence
    FROM posts JOIN fresh USING (actor_id) GROUP BY ALL HAVING count(DISTINCT actor_id) >= 5""",
)
def fresh_account_swarm(spark, sf_dir):
    found = co.fresh_account_swarm(user_actors(spark, sf_dir), posts(spark, sf_dir), SWARM_AT)
    return found.withColumn("confidence", F.round("confidence", 9))


STARS = """
rp AS (SELECT * FROM edges WHERE edge_type = 'REPOSTED'),
hubs AS (SELECT dst AS hub, count(DISTINCT src) AS leaf_count, sum(interaction_count)::BIGINT AS repost_count
         FROM rp GROUP BY ALL HAVING count(DISTINCT src) >= 10 AND sum(interaction_count) >= 20),
leaves AS (SELECT DISTINCT dst AS hub, src AS leaf FROM rp JOIN hubs ON dst = hub),
li AS (SELECT a.hub, 2 * count(*) AS n FROM edges e JOIN leaves a ON a.leaf = e.src
       JOIN leaves b ON b.hub = a.hub AND b.leaf = e.dst WHERE e.src <> e.dst GROUP BY ALL),
stars AS (
  SELECT hub, leaf_count, repost_count, coalesce(n, 0) AS leaf_links,
         round(coalesce(n, 0) / (leaf_count * (leaf_count - 1) / 2), 4) AS leaf_connectivity,
         round(least(0.90, 0.6 + (leaf_count - 10) * 0.02), 9)::DOUBLE AS confidence
  FROM hubs LEFT JOIN li USING (hub)
  WHERE coalesce(n, 0) < leaf_count AND coalesce(n, 0) / (leaf_count * (leaf_count - 1) / 2) < 0.1)"""


@query("star_topology", f"WITH {MERGED_EDGES}, {STARS} SELECT * FROM stars")
def star_topology(spark, sf_dir):
    found = co.star_topology(counted_edges(interactions(spark, sf_dir)))
    return found.withColumn("confidence", F.round("confidence", 9))


def _signal_tables(spark, sf_dir):
    """Swarm signals of the users, with their accounts."""
    actors, p = user_actors(spark, sf_dir), posts(spark, sf_dir)
    swarm = co.fresh_account_swarm(actors, p, SWARM_AT)
    signals = co.as_signals(
        swarm, "fresh_account_swarm", SWARM_AT, ["accounts"], narrative="narrative_id", key=["narrative_id"]
    )
    fresh = co.fresh_accounts(actors, SWARM_AT)
    taking = p.select("narrative_id", "actor_id").distinct().join(fresh, "actor_id")
    named = taking.withColumn("narrative_id", F.col("narrative_id").cast("string"))
    members = signals.select("signal_id", "narrative_id").join(named, "narrative_id").select("signal_id", "actor_id")
    return signals, members


SIGNALS = f"""
fresh AS (SELECT actor_id FROM actors WHERE first_seen > TIMESTAMP '{SWARM_AT}' - INTERVAL 7 DAY
          AND first_seen <= TIMESTAMP '{SWARM_AT}' AND content_count >= 3),
swarm AS (
  SELECT narrative_id, count(DISTINCT actor_id) AS accounts, least(0.90, 0.5 + (count(DISTINCT actor_id) - 5) * 0.05)::DOUBLE AS confidence
  FROM posts JOIN fresh USING (actor_id) GROUP BY ALL HAVING count(DISTINCT actor_id) >= 5),
signals AS (
  SELECT left(sha256('fresh_account_swarm|' || narrative_id), 32) AS signal_id, 'fresh_account_swarm' AS type,
         CAST(narrative_id AS VARCHAR) AS narrative_id, confidence, TIMESTAMP '{SWARM_AT}' AS detected_at FROM swarm),
signal_accounts AS (
  SELECT DISTINCT s.signal_id, p.actor_id FROM signals s JOIN posts p ON CAST(p.narrative_id AS VARCHAR) = s.narrative_id
  JOIN fresh USING (actor_id))"""


@query(
    "signal_rows",
    f"WITH {POSTS}, {USER_ACTORS}, {SIGNALS} SELECT signal_id, type, narrative_id, round(confidence, 9) AS confidence, "
    "epoch(detected_at)::BIGINT AS detected_at FROM signals",
)
def signal_rows(spark, sf_dir):
    signals, _ = _signal_tables(spark, sf_dir)
    return signals.select(
        "signal_id", "type", "narrative_id", F.round("confidence", 9).alias("confidence"),
        F.unix_timestamp("detected_at").alias("detected_at"),
    )


@query(
    "signal_graph",
    f"""WITH {POSTS}, {USER_ACTORS}, {SIGNALS},
    f AS (SELECT signal_id, min(actor_id) AS src FROM signal_accounts GROUP BY ALL)
    SELECT src, actor_id AS dst, signal_id FROM signal_accounts JOIN f USING (signal_id) WHERE actor_id <> src""",
)
def signal_graph(spark, sf_dir):
    return co.signal_graph(_signal_tables(spark, sf_dir)[1])


@query(
    "recent_signals",
    f"""WITH {MERGED_EDGES}, {STARS}
    SELECT hub, round(confidence, 9) AS confidence FROM stars WHERE leaf_count % 5 * 20 < 48""",
)
def recent_signals(spark, sf_dir):
    stars = co.star_topology(counted_edges(interactions(spark, sf_dir)))
    when = F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=(F.col("leaf_count") % 5 * 20).cast("int"))
    signals = co.as_signals(stars, "star_topology", when, ["hub", "leaf_count", "repost_count"], key=["hub"])
    kept = co.recent_signals(signals, NOW, 48)
    return kept.select(F.col("evidence")["hub"].alias("hub"), F.round("confidence", 9).alias("confidence"))


@query(
    "cluster_reach",
    f"""WITH {MERGED_EDGES}, {STARS}, {ACCOUNTS}
    SELECT hub, sum(coalesce(follower_count, 0))::BIGINT AS estimated_reach
    FROM stars JOIN leaves USING (hub) LEFT JOIN accounts ON leaf = actor_id GROUP BY hub""",
)
def cluster_reach(spark, sf_dir):
    _, members = co.stars_and_accounts(counted_edges(interactions(spark, sf_dir)))
    return co.cluster_reach(members.filter("role = 'leaf'"), accounts(spark, sf_dir), ["hub"])


CLUSTERS = """
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pairs),
se AS (SELECT f.src AS u, a.actor_id AS v, a.signal_id FROM signal_accounts a
       JOIN (SELECT signal_id, min(actor_id) AS src FROM signal_accounts GROUP BY ALL) f USING (signal_id) WHERE a.actor_id <> f.src),
sym AS (SELECT DISTINCT u, v FROM se UNION SELECT DISTINCT v, u FROM se),
reach AS (
  WITH RECURSIVE walk(a, b) AS (SELECT u, u FROM sym UNION SELECT w.a, s.v FROM walk w JOIN sym s ON s.u = w.b) SELECT a, b FROM walk),
comp AS (SELECT a AS actor_id, min(b) AS component FROM reach GROUP BY a),
members AS (SELECT * FROM comp WHERE component IN (SELECT component FROM comp GROUP BY ALL HAVING count(*) >= 3)),
sized AS (SELECT component, count(*) AS account_count FROM members GROUP BY ALL),
agg AS (
  SELECT component, 1 - product(1 - s.confidence) AS c, count(*) AS signal_count, count(DISTINCT narrative_id) AS narrative_count
  FROM (SELECT DISTINCT signal_id, u FROM se) e JOIN members ON u = actor_id JOIN signals s USING (signal_id) GROUP BY ALL),
organic AS (
  SELECT m.component, count(*) AS n FROM und JOIN members m ON und.a = m.actor_id
  JOIN members o ON o.component = m.component AND o.actor_id = und.b GROUP BY ALL),
rated AS (
  SELECT component, account_count, signal_count, narrative_count,
         CASE WHEN coalesce(n, 0) / (account_count * (account_count - 1) / 2) > 0.2 THEN c * 0.5 ELSE c END AS confidence
  FROM agg JOIN sized USING (component) LEFT JOIN organic USING (component) WHERE c >= 0.5),
clusters AS (
  SELECT left(sha256('cluster|' || component), 32) AS cluster_id, component, account_count, signal_count, narrative_count,
         round(confidence, 4) AS confidence,
         CASE WHEN confidence > 0.9 THEN 'critical' WHEN confidence > 0.75 THEN 'high' ELSE 'medium' END AS severity
  FROM rated WHERE confidence >= 0.5)"""


def _clusters(spark, sf_dir):
    signals, members = _signal_tables(spark, sf_dir)
    actors = user_actors(spark, sf_dir).withColumn("follower_count", F.col("content_count"))
    return coordination_clusters(signals, members, pair_weights(spark, sf_dir), actors)


@query(
    "coordination_clusters",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}
    SELECT cluster_id, account_count, signal_count, narrative_count, confidence, severity,
           (SELECT sum(content_count)::BIGINT FROM members m JOIN actors a USING (actor_id) WHERE m.component = c.component) AS estimated_reach
    FROM clusters c""",
)
def clusters(spark, sf_dir):
    found, _ = _clusters(spark, sf_dir)
    return found.select(
        "cluster_id", "account_count", "signal_count", "narrative_count", "confidence", "severity", "estimated_reach"
    )


@query(
    "tag_cluster_members",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}
    SELECT a.actor_id, cluster_id AS coordination_cluster_id FROM actors a
    LEFT JOIN (SELECT actor_id, cluster_id FROM members JOIN clusters USING (component)) USING (actor_id)""",
)
def tagged(spark, sf_dir):
    _, members = _clusters(spark, sf_dir)
    return co.tag_cluster_members(user_actors(spark, sf_dir).select("actor_id"), members)


@query(
    "cluster_alerts",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}
    SELECT cluster_id, confidence, account_count, severity FROM clusters WHERE confidence > 0.45""",
)
def alerts(spark, sf_dir):
    found, _ = _clusters(spark, sf_dir)
    return co.cluster_alerts(found, 0.45).select("cluster_id", "confidence", "account_count", "severity")


@query(
    "star_accounts",
    f"""WITH {MERGED_EDGES}, {STARS}
    SELECT hub, leaf AS actor_id, 'leaf' AS role FROM (SELECT DISTINCT hub, leaf FROM leaves) JOIN (SELECT hub FROM stars) USING (hub)
    UNION ALL SELECT hub, hub, 'hub' FROM stars""",
)
def star_accounts(spark, sf_dir):
    return co.stars_and_accounts(counted_edges(interactions(spark, sf_dir)))[1]


def _contents(spark, sf_dir):
    signals, accounts_of = _signal_tables(spark, sf_dir)
    _, members = _clusters(spark, sf_dir)
    return cluster_signals(signals, accounts_of, members)


CONTENTS = """
contents AS (
  SELECT DISTINCT cluster_id, signal_id, narrative_id, round(s.confidence, 9) AS confidence
  FROM se JOIN members ON u = actor_id JOIN clusters c USING (component) JOIN signals s USING (signal_id))"""


@query("cluster_signals", f"WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}, {CONTENTS} SELECT * FROM contents")
def signals_of_clusters(spark, sf_dir):
    found = _contents(spark, sf_dir)
    return found.select("cluster_id", "signal_id", "narrative_id", F.round("confidence", 9).alias("confidence"))


@query(
    "cluster_narratives",
    f"""WITH {PAIR_WEIGHTS}, {USER_ACTORS}, {SIGNALS}, {CLUSTERS}, {CONTENTS}
    SELECT cluster_id, narrative_id, count(*) AS signal_count FROM contents WHERE narrative_id IS NOT NULL GROUP BY ALL""",
)
def narratives_of_clusters(spark, sf_dir):
    return cluster_narratives(_contents(spark, sf_dir)).select("cluster_id", "narrative_id", "signal_count")
