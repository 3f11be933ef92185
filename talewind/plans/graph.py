"""Actor graph over sample threads, interactions and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.functions.times import micros
from talewind.operators import graph_build as gb
from talewind.operators import graph_query as gq
from talewind.operators.betweenness import betweenness
from talewind.operators.components import connected_components
from talewind.operators.louvain import communities, modularity, undirected_weights
from talewind.operators.paths import shortest_path
from talewind.operators.rank import ROUNDS, influence_scores, pagerank, top_bridges
from talewind.plans.catalog import query
from talewind.plans.tables import (
    ACCOUNTS, INTERACTIONS, MERGED_EDGES, PAIR_WEIGHTS, POSTS, USER_ACTORS, accounts, interactions, pair_weights, posts, table,
    user_actors,
)
from talewind.session import cut_lineage


def thread_posts(spark, sf_dir):
    """Conversation turns as posts: the parent is the turn before, the root the first turn; a minute per turn.
    Every third word of an '@' name is not in the data, so mentions come from the roles: a turn mentions its own role."""
    t = table(spark, sf_dir, "conversations")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))
    key = F.concat_ws(":", "conv_id", "turn")
    return t.select(
        key.alias("content_id"), F.lit("forum").alias("platform"),
        F.when(F.col("turn") == 0, "post").when(F.col("turn") % 3 == 2, "repost").when(F.col("turn") % 5 == 3, "quote").otherwise("reply")
        .alias("content_type"),
        at.alias("created_at"),
        F.concat(F.col("role"), F.lit("-"), F.length("text") % 50).alias("actor_id"),
        F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent_id"),
        F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.lit(0))).alias("root_id"),
        F.array("role").alias("mentions"),
        F.when(F.col("turn") % 4 == 3, F.concat(F.lit("ch"), F.col("conv_id") % 7)).alias("forwarded_from"),
        F.col("conv_id").cast("string").alias("narrative_id"), "text",
    )


THREADS = """
threads AS (
  SELECT conv_id || ':' || turn AS content_id, 'forum' AS platform,
    CASE WHEN turn = 0 THEN 'post' WHEN turn % 3 = 2 THEN 'repost' WHEN turn % 5 = 3 THEN 'quote' ELSE 'reply' END AS content_type,
    epoch_us(TIMESTAMP '2024-01-01') + (conv_id * 10 + turn) * 60000000 AS us,
    role || '-' || (length(text) % 50) AS actor_id,
    CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_id, CASE WHEN turn > 0 THEN conv_id || ':0' END AS root_id,
    role, CASE WHEN turn % 4 = 3 THEN 'ch' || (conv_id % 7) END AS forwarded_from
  FROM conversations)"""



def uuid5_sql(expr: str) -> str:
    """SQL of the version-5 UUID in the URL namespace."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({expr}))"
    return (
        f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||translate(substr(h,17,1),'0123456789abcdef',"
        f"'89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) FROM (SELECT {h} AS h))"
    )


@query(
    "build_actors",
    f"""WITH {POSTS}
    SELECT {uuid5_sql("platform || ':' || actor_id")} AS actor_uuid, platform AS primary_platform, CAST(actor_id AS VARCHAR) AS platform_id,
      arg_max(CAST(value * 100 AS BIGINT), us) FILTER (value > 10) AS follower_count, epoch_us(min(created_at)) AS first_seen,
      epoch_us(max(created_at)) AS last_seen, count(*) AS content_count, arg_min('u' || narrative_id, us) AS username
    FROM posts GROUP BY platform, actor_id""",
)
def build_actors(spark, sf_dir):
    content = posts(spark, sf_dir).select(
        "platform", F.col("content_id").alias("platform_content_id"), "created_at",
        F.struct(
            F.col("actor_id").cast("string").alias("platform_id"), F.concat(F.lit("u"), "narrative_id").alias("username"),
            F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("bio"), F.lit(False).alias("is_verified"),
            F.when(F.col("value") > 10, F.round(F.col("value") * 100)).cast("long").alias("follower_count"),
        ).alias("actor"),
    )
    found = gb.build_actors(content)
    return found.select(
        F.col("actor_id").alias("actor_uuid"), "primary_platform", "platform_id", "follower_count", micros("first_seen").alias("first_seen"),
        micros("last_seen").alias("last_seen"), "content_count", "username",
    )


@query(
    "resolve_parent_author",
    f"""WITH {THREADS} SELECT c.content_id, c.actor_id, p.actor_id AS target FROM threads c JOIN threads p
    ON p.content_id = c.parent_id AND p.platform = c.platform AND c.us - p.us BETWEEN 0 AND 7 * 86400000000""",
)
def resolve_parent_author(spark, sf_dir):
    return gb.resolve_parent_author(thread_posts(spark, sf_dir)).select("content_id", "actor_id", "target")


def _edges_out(df):
    return df.select("src", "dst", "edge_type", micros("ts").alias("us"), "content_id")


@query(
    "reply_edges",
    f"""WITH {THREADS}, a AS (SELECT * FROM threads WHERE content_type NOT IN ('repost', 'quote')),
    r AS (SELECT c.*, p.actor_id AS dst FROM a c JOIN threads p ON p.content_id = c.parent_id AND c.us - p.us BETWEEN 0 AND 7 * 86400000000
          UNION ALL SELECT c.*, p.actor_id FROM a c JOIN threads p ON p.content_id = c.root_id AND c.us - p.us BETWEEN 0 AND 7 * 86400000000
          WHERE c.root_id IS NOT NULL AND c.root_id IS DISTINCT FROM c.parent_id)
    SELECT actor_id AS src, dst, 'REPLIED_TO' AS edge_type, us, content_id FROM r WHERE actor_id <> dst""",
)
def reply_edges(spark, sf_dir):
    return _edges_out(gb.reply_edges(thread_posts(spark, sf_dir)))


@query(
    "repost_quote_edges",
    f"""WITH {THREADS}
    SELECT c.actor_id AS src, p.actor_id AS dst, CASE c.content_type WHEN 'repost' THEN 'REPOSTED' ELSE 'QUOTED' END AS edge_type, c.us, c.content_id
    FROM threads c JOIN threads p ON p.content_id = c.parent_id AND c.us - p.us BETWEEN 0 AND 7 * 86400000000
    WHERE c.content_type IN ('repost', 'quote') AND c.actor_id <> p.actor_id""",
)
def repost_quote_edges(spark, sf_dir):
    return _edges_out(gb.repost_quote_edges(thread_posts(spark, sf_dir)))


@query(
    "mention_edges",
    f"""WITH {THREADS} SELECT actor_id AS src, {uuid5_sql("'forum:' || role")} AS dst, 'MENTIONED' AS edge_type, us, content_id FROM threads""",
)
def mention_edges(spark, sf_dir):
    return _edges_out(gb.mention_edges(thread_posts(spark, sf_dir)))


@query(
    "forward_edges",
    f"""WITH {THREADS} SELECT actor_id AS src, {uuid5_sql("'telegram:' || forwarded_from")} AS dst, 'FORWARDED_FROM' AS edge_type, us, content_id
    FROM threads WHERE forwarded_from IS NOT NULL""",
)
def forward_edges(spark, sf_dir):
    return _edges_out(gb.forward_edges(thread_posts(spark, sf_dir)))


@query(
    "stub_actors",
    f"""WITH {THREADS}, n AS (SELECT 'forum' AS platform, role AS platform_id, us FROM threads
      UNION ALL SELECT 'telegram', forwarded_from, us FROM threads WHERE forwarded_from IS NOT NULL)
    SELECT {uuid5_sql("platform || ':' || platform_id")} AS actor_id, platform AS primary_platform, platform_id, min(us) AS first_seen,
      max(us) AS last_seen, 0::BIGINT AS content_count FROM n GROUP BY platform, platform_id""",
)
def stub_actors(spark, sf_dir):
    found = gb.stub_actors(thread_posts(spark, sf_dir))
    return found.select(
        "actor_id", "primary_platform", "platform_id", micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"),
        "content_count",
    )


@query(
    "merge_edges",
    f"""WITH {MERGED_EDGES} SELECT src, dst, edge_type, round(weight, 9) AS weight, interaction_count,
      epoch_us(first_interaction) AS first_us, epoch_us(last_interaction) AS last_us FROM edges""",
)
def merge_edges(spark, sf_dir):
    found = gb.merge_edges(interactions(spark, sf_dir))
    return found.select(
        "src", "dst", "edge_type", F.round("weight", 9).alias("weight"), "interaction_count", micros("first_interaction").alias("first_us"),
        micros("last_interaction").alias("last_us"),
    )


@query("edge_narratives", f"WITH {INTERACTIONS} SELECT DISTINCT src, dst, edge_type, narrative_id FROM interactions")
def edge_narratives(spark, sf_dir):
    return gb.edge_narratives(interactions(spark, sf_dir))


AUTHORS = """
authors AS (
  SELECT narrative_id, actor_id, content_count,
         row_number() OVER (PARTITION BY narrative_id ORDER BY content_count DESC, actor_id) AS rank
  FROM (SELECT DISTINCT narrative_id, actor_id FROM posts) JOIN actors USING (actor_id)
  QUALIFY rank <= 20)"""


@query("narrative_authors", f"WITH {POSTS}, {USER_ACTORS}, {AUTHORS} SELECT * FROM authors")
def narrative_authors(spark, sf_dir):
    found = gb.narrative_authors(posts(spark, sf_dir), user_actors(spark, sf_dir), 20)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "co_narrative_edges",
    f"""WITH {POSTS}, {USER_ACTORS}, {AUTHORS}
    SELECT a.actor_id AS src, b.actor_id AS dst, 'CO_NARRATIVE' AS edge_type, count(*) AS interaction_count,
           round(1 + 0.1 * (count(*) - 1), 9)::DOUBLE AS weight
    FROM authors a JOIN authors b ON a.narrative_id = b.narrative_id AND a.actor_id < b.actor_id GROUP BY ALL""",
)
def co_narrative_edges(spark, sf_dir):
    found = gb.co_narrative_edges(gb.narrative_authors(posts(spark, sf_dir), user_actors(spark, sf_dir), 20))
    return found.withColumn("weight", F.round("weight", 9))


@query(
    "graph_projection",
    f"""WITH {MERGED_EDGES}, e AS (
      SELECT src, dst, CASE edge_type WHEN 'MENTIONED' THEN 'CO_NARRATIVE' WHEN 'REPLIED_TO' THEN 'SAME_PERSON' ELSE edge_type END AS edge_type,
             round(weight, 9) AS weight FROM edges)
    SELECT * FROM e WHERE edge_type <> 'SAME_PERSON' UNION ALL SELECT dst, src, edge_type, weight FROM e WHERE edge_type = 'CO_NARRATIVE'""",
)
def graph_projection(spark, sf_dir):
    kind = F.when(F.col("edge_type") == "MENTIONED", "CO_NARRATIVE").when(F.col("edge_type") == "REPLIED_TO", "SAME_PERSON")
    edges = gb.merge_edges(interactions(spark, sf_dir)).withColumn("edge_type", F.coalesce(kind, F.col("edge_type")))
    return gb.graph_projection(edges).withColumn("weight", F.round("weight", 9))


@query(
    "amplification_score",
    f"WITH {MERGED_EDGES} SELECT dst AS actor_id, sum(interaction_count)::BIGINT AS amplification_score FROM edges WHERE edge_type = 'REPOSTED' GROUP BY ALL",
)
def amplification_score(spark, sf_dir):
    return gb.amplification_score(gb.merge_edges(interactions(spark, sf_dir)))


# --- iterative ----------------------------------------------------------------------------------------------------------

RANK_ROUNDS = 10


def _pagerank_sql(n: int = RANK_ROUNDS) -> str:
    rounds = [
        f"""r{i} AS MATERIALIZED (SELECT n.id, 0.15 + 0.85 * coalesce(sum(r.rank * l.share), 0) AS rank
        FROM nodes n LEFT JOIN links l ON l.dst = n.id LEFT JOIN r{i - 1} r ON r.id = l.src GROUP BY n.id)"""
        for i in range(1, n + 1)
    ]
    last = f"r{n}"
    return f"""WITH {PAIR_WEIGHTS},
    links AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM pairs),
    nodes AS MATERIALIZED (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs),
    r0 AS (SELECT id, 0.15::DOUBLE AS rank FROM nodes), {", ".join(rounds)}
    SELECT id AS actor_id, round(rank / (SELECT sum(rank) FROM {last}), 9) AS pagerank FROM {last}"""


@query("pagerank", _pagerank_sql())
def pagerank_query(spark, sf_dir):
    found = pagerank(pair_weights(spark, sf_dir), rounds=RANK_ROUNDS, tolerance=0.0)
    return found.withColumn("pagerank", F.round("pagerank", 9))


@query("pagerank_in_full", _pagerank_sql(ROUNDS))
def pagerank_in_full(spark, sf_dir):
    found = pagerank(pair_weights(spark, sf_dir), tolerance=0.0)
    return found.withColumn("pagerank", F.round("pagerank", 9))


@query(
    "connected_components",
    f"""WITH RECURSIVE {THREADS},
    e AS (SELECT c.actor_id AS a, p.actor_id AS b FROM threads c JOIN threads p ON p.content_id = c.parent_id WHERE c.actor_id <> p.actor_id),
    sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk(s, n) AS (SELECT a, a FROM sym UNION SELECT w.s, sym.b FROM walk w JOIN sym ON sym.a = w.n)
    SELECT s AS actor_id, min(n) AS component FROM walk GROUP BY s""",
)
def components(spark, sf_dir):
    linked = gb.resolve_parent_author(thread_posts(spark, sf_dir))
    return connected_components(linked.select(F.col("actor_id").alias("src"), F.col("target").alias("dst")))


@query("betweenness")
def betweenness_query(spark, sf_dir):
    # The default sample is larger than the sample graph, so every user is a source.
    found = betweenness(pair_weights(spark, sf_dir))
    return found.withColumn("betweenness", F.round("betweenness", 6))


@query("communities")
def communities_query(spark, sf_dir):
    return communities(pair_weights(spark, sf_dir))


@query("community_modularity")
def community_modularity(spark, sf_dir):
    linked = gb.resolve_parent_author(thread_posts(spark, sf_dir)).filter(F.col("actor_id") != F.col("target"))
    edges = linked.groupBy(F.col("actor_id").alias("src"), F.col("target").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    found = communities(edges)
    labels = found.select(F.col("actor_id").alias("node"), F.col("community_id").alias("label"))
    score = modularity(undirected_weights(edges), labels)
    return found.groupBy("community_id").agg(F.count("*").alias("members")).withColumn("modularity", F.lit(round(score, 9)))


PATH = f"""
hop0 AS (SELECT 'c1' AS id, 0 AS d),
sym AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
walk(id, d) AS (SELECT 'c1', 0 UNION SELECT s.b, w.d + 1 FROM walk w JOIN sym s ON s.a = w.id WHERE w.d < 4)"""


@query(
    "shortest_path_length",
    f"""WITH RECURSIVE {MERGED_EDGES}, {PATH}
    SELECT min(d)::BIGINT AS path_length, count(*) FILTER (true) > 0 AS found FROM walk WHERE id = 'c2'""",
)
def shortest_path_length(spark, sf_dir):
    path = shortest_path(gb.merge_edges(interactions(spark, sf_dir)), "c1", "c2")
    return path.agg(F.max("step").cast("long").alias("path_length"), (F.count("*") > 0).alias("found"))


@query("shortest_path")
def shortest_path_query(spark, sf_dir):
    return shortest_path(gb.merge_edges(interactions(spark, sf_dir)), "c1", "c2")


# --- scores and look-ups ------------------------------------------------------------------------------------------------

SCORED = """
deg AS (SELECT actor_id, sum(n)::BIGINT AS degree FROM (
  SELECT src AS actor_id, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT dst, count(*) FROM edges GROUP BY ALL) GROUP BY ALL),
amp AS (SELECT dst AS actor_id, sum(interaction_count)::BIGINT AS amplification_score FROM edges WHERE edge_type = 'REPOSTED' GROUP BY ALL),
narr AS (SELECT src AS actor_id, count(DISTINCT narrative_id) AS narrative_count FROM interactions GROUP BY ALL),
base AS (
  SELECT a.*, coalesce(degree, 0) * 50.0::DOUBLE AS betweenness, coalesce(degree, 0) / 10000.0::DOUBLE AS pagerank,
         coalesce(amplification_score, 0) AS amplification_score, coalesce(narrative_count, 0) AS narrative_count
  FROM accounts a LEFT JOIN deg USING (actor_id) LEFT JOIN amp USING (actor_id) LEFT JOIN narr USING (actor_id)),
scored AS (
  SELECT *, round(0.30 * least(pagerank / 0.01, 1) + 0.25 * least(amplification_score / 1000, 1) + 0.25 * least(betweenness / 10000, 1)
         + 0.20 * least(narrative_count / 20, 1), 9) AS influence_score, round(least(betweenness / 10000, 1), 9) AS bridge_score,
         primary_platform AS community_id
  FROM base)"""


def scored_actors(spark, sf_dir, edges=None):
    """Accounts with influence and bridge score; degrees stand in for the iterative scores, nations for communities."""
    events = interactions(spark, sf_dir)
    edges = cut_lineage(gb.counted_edges(events)) if edges is None else edges
    ends = edges.select(F.explode(F.array("src", "dst")).alias("actor_id")).groupBy("actor_id").agg(F.count("*").alias("degree"))
    narr = events.groupBy(F.col("src").alias("actor_id")).agg(F.count_distinct("narrative_id").alias("narrative_count"))
    joined = accounts(spark, sf_dir).join(ends, "actor_id", "left").join(gb.amplification_score(edges), "actor_id", "left").join(
        narr, "actor_id", "left"
    )
    degree = F.coalesce("degree", F.lit(0))
    base = joined.withColumn("betweenness", degree * 50.0).withColumn("pagerank", degree / 10000.0)
    scored = influence_scores(base.withColumn("community_id", F.col("primary_platform")))
    return scored.withColumn("influence_score", F.round("influence_score", 9)).withColumn("bridge_score", F.round("bridge_score", 9)).withColumn(
        "display_name", F.lit(None).cast("string")
    )


@query("influence_scores", f"WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED} SELECT actor_id, influence_score, bridge_score FROM scored")
def influence(spark, sf_dir):
    return scored_actors(spark, sf_dir).select("actor_id", "influence_score", "bridge_score")


@query(
    "top_bridges",
    f"""WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED}
    SELECT actor_id, bridge_score, influence_score FROM scored WHERE bridge_score > 0.3 ORDER BY bridge_score DESC, actor_id LIMIT 1000""",
)
def bridges(spark, sf_dir):
    return top_bridges(scored_actors(spark, sf_dir)).select("actor_id", "bridge_score", "influence_score")


@query(
    "community_summary",
    f"""WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED}
    SELECT side AS community_id, count(*) AS member_count, array_to_string(list_slice(list_sort(list(DISTINCT primary_platform)), 1, 5), '|') AS platforms,
           round(avg(influence_score), 9) AS avg_influence FROM scored GROUP BY side""",
)
def community_summary(spark, sf_dir):
    actors = scored_actors(spark, sf_dir).withColumn("community_id", F.col("side"))
    found = gq.community_summary(actors)
    return found.select(
        "community_id", "member_count", F.array_join("sample_platforms", "|").alias("platforms"), F.round("avg_influence", 9).alias("avg_influence")
    )


@query(
    "network_stats",
    f"WITH {MERGED_EDGES}, {ACCOUNTS} SELECT (SELECT count(*) FROM accounts) AS node_count, (SELECT count(*) FROM edges) AS edge_count",
)
def network_stats(spark, sf_dir):
    return gq.network_stats(accounts(spark, sf_dir), gb.merge_edges(interactions(spark, sf_dir)))


TOP_NODES = """
nodes AS (SELECT * FROM scored WHERE influence_score >= 0.2 ORDER BY influence_score DESC, actor_id LIMIT 300)"""


@query("subgraph_nodes", f"WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED}, {TOP_NODES} SELECT actor_id, primary_platform, influence_score FROM nodes")
def subgraph_nodes(spark, sf_dir):
    edges = cut_lineage(gb.merge_edges(interactions(spark, sf_dir)))
    nodes, _ = gq.subgraph(scored_actors(spark, sf_dir, edges), edges, min_influence=0.2, limit=300)
    return nodes.select("actor_id", "primary_platform", "influence_score")


@query(
    "subgraph_edges",
    f"""WITH {MERGED_EDGES}, {ACCOUNTS}, {SCORED}, {TOP_NODES}
    SELECT src, dst, edge_type, round(weight, 9) AS weight, interaction_count FROM edges
    WHERE src IN (SELECT actor_id FROM nodes) AND dst IN (SELECT actor_id FROM nodes)""",
)
def subgraph_edges(spark, sf_dir):
    edges = cut_lineage(gb.merge_edges(interactions(spark, sf_dir)))
    _, inside = gq.subgraph(scored_actors(spark, sf_dir, edges), edges, min_influence=0.2, limit=300)
    return inside.withColumn("weight", F.round("weight", 9))


@query(
    "actor_profile",
    f"""WITH {MERGED_EDGES}, {ACCOUNTS}
    SELECT actor_id, username, primary_platform, (SELECT count(*) FROM edges WHERE src = 's5') AS outgoing_connections,
      (SELECT count(*) FROM edges WHERE dst = 's5') AS incoming_connections,
      (SELECT string_agg(x.actor_id || '/' || x.username, '|' ORDER BY x.actor_id) FROM accounts x
       WHERE x.actor_id <> 's5' AND x.primary_platform <> a.primary_platform AND right(x.username, 9) = right(a.username, 9)) AS linked
    FROM accounts a WHERE actor_id = 's5'""",
)
def actor_profile(spark, sf_dir):
    people = accounts(spark, sf_dir)
    number = people.select(F.right("username", F.lit(9)).alias("_k"), "actor_id", F.col("primary_platform").alias("_p"))
    other = number.select("_k", F.col("actor_id").alias("actor_b"), F.col("_p").alias("_q"))
    links = number.join(other, "_k").filter((F.col("actor_id") < F.col("actor_b")) & (F.col("_p") != F.col("_q"))).select(
        F.col("actor_id").alias("actor_a"), "actor_b"
    )
    found = gq.actor_profile(people, gb.merge_edges(interactions(spark, sf_dir)), links, "s5")
    linked = F.array_join(F.transform("linked_accounts", lambda x: F.concat_ws("/", x["actor_id"], x["username"])), "|")
    return found.select(
        "actor_id", "username", "primary_platform", "outgoing_connections", "incoming_connections", F.nullif(linked, F.lit("")).alias("linked")
    )


@query(
    "actor_history",
    f"""WITH {POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, content_id DESC) AS n FROM posts WHERE actor_id = 7)
    SELECT content_id, platform, us FROM r WHERE n <= 10 ORDER BY us DESC, content_id DESC LIMIT 40""",
)
def actor_history(spark, sf_dir):
    found = gq.actor_history(posts(spark, sf_dir), 7, per_platform=10, limit=40)
    return found.select("content_id", "platform", micros("created_at").alias("us"))
