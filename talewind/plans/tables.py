"""The sample tables seen as posts, accounts, interactions and texts, in Spark and in SQL.

events        -> posts: platform = event_type, account = user_id, narrative = k of props (``topic``: k in ten groups)
orders x lineitem -> interactions: customer -> supplier, type by return flag
conversations -> threads: the parent of a turn is the turn before
documents     -> texts: community = source
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The last moment of the sample events; "now" of the queries that look back.
NOW = "2024-01-31 00:00:00"
# Where the month of events is cut into a baseline and a current half.
HALF = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The files hold times without a zone; the engine works on instants.
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("content_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("actor_id"),
        F.col("event_type").alias("platform"), "value", k.alias("narrative_id"), (k % 10).alias("topic"),
    )


POSTS = """
posts AS (
  SELECT event_id AS content_id, ts AS created_at, epoch_us(ts) AS us, user_id AS actor_id, event_type AS platform, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS narrative_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS topic
  FROM events)"""


def topic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the ten broad topics as narratives."""
    return posts(spark, sf_dir).drop("narrative_id").withColumnRenamed("topic", "narrative_id")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> supplier, one per line item. Account ids: customers 'c<n>', suppliers 's<n>'."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "R", "REPOSTED").when(F.col("l_returnflag") == "A", "REPLIED_TO").otherwise("MENTIONED")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), kind.alias("edge_type"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("platform"),
        F.col("l_partkey").cast("string").alias("narrative_id"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("content_id"),
    )


INTERACTIONS = """
interactions AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst,
         CASE l_returnflag WHEN 'R' THEN 'REPOSTED' WHEN 'A' THEN 'REPLIED_TO' ELSE 'MENTIONED' END AS edge_type,
         o_orderdate AS ts, epoch_us(o_orderdate) AS us, o_orderpriority AS platform,
         CAST(l_partkey AS VARCHAR) AS narrative_id, l_orderkey * 1000 + l_linenumber AS content_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MERGED_EDGES = INTERACTIONS + """,
gaps AS (
  SELECT *, lag(us) OVER (PARTITION BY src, dst, edge_type ORDER BY us, content_id) AS prev FROM interactions),
edges AS (
  SELECT src, dst, edge_type,
         sum(CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + (us - prev) // 86400000000) END) AS weight,
         count(*) AS interaction_count, min(ts) AS first_interaction, max(ts) AS last_interaction
  FROM gaps GROUP BY ALL)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> user edges: a post answers the post before it in the same narrative."""
    from talewind.functions.times import micros
    from talewind.operators.skew import with_previous

    timed = posts(spark, sf_dir).withColumn("_us", micros("created_at"))
    linked = with_previous(timed, ["narrative_id"], "_us", ["_us", "content_id"], {"target": "actor_id"})
    return linked.filter(F.col("target").isNotNull() & (F.col("target") != F.col("actor_id"))).select(
        F.col("actor_id").alias("src"), F.col("target").alias("dst"), F.lit("REPLIED_TO").alias("edge_type"),
        F.col("created_at").alias("ts"), "platform", F.col("narrative_id").cast("string").alias("narrative_id"), "content_id",
    )


ANSWERS = POSTS + """,
linked AS (
  SELECT *, lag(actor_id) OVER (PARTITION BY narrative_id ORDER BY us, content_id) AS target FROM posts),
answers AS (
  SELECT actor_id AS src, target AS dst, 'REPLIED_TO' AS edge_type, created_at AS ts, us, platform, narrative_id, content_id
  FROM linked WHERE target IS NOT NULL AND target <> actor_id)"""


def pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> user graph with one weighted edge per pair."""
    return answers(spark, sf_dir).groupBy("src", "dst", "edge_type").agg(
        F.count("*").alias("interaction_count"), F.count("*").cast("double").alias("weight")
    )


PAIR_WEIGHTS = ANSWERS + """,
pairs AS (
  SELECT src, dst, edge_type, count(*) AS interaction_count, count(*)::DOUBLE AS weight FROM answers GROUP BY ALL)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as accounts; nations are platforms, balances stand for followers."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("actor_id"), F.col("c_name").alias("username"),
        F.col("c_nationkey").alias("_n"), F.col("c_acctbal").alias("_b"), F.lit("customer").alias("side"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("actor_id"), F.col("s_name").alias("username"),
        F.col("s_nationkey").alias("_n"), F.col("s_acctbal").alias("_b"), F.lit("supplier").alias("side"),
    )
    return c.unionByName(s).join(nation, F.col("_n") == F.col("n_nationkey")).select(
        "actor_id", "username", F.col("n_name").alias("primary_platform"), F.floor("_b").alias("follower_count"), "side"
    )


ACCOUNTS = """
accounts AS (
  SELECT actor_id, username, n_name AS primary_platform, CAST(floor(b) AS BIGINT) AS follower_count, side
  FROM (SELECT 'c' || c_custkey AS actor_id, c_name AS username, c_nationkey AS n, c_acctbal AS b, 'customer' AS side FROM customer
        UNION ALL SELECT 's' || s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier)
  JOIN nation ON n = n_nationkey)"""


def user_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting user."""
    return posts(spark, sf_dir).groupBy("actor_id").agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count("*").alias("content_count")
    )


USER_ACTORS = """
actors AS (
  SELECT actor_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS content_count
  FROM posts GROUP BY actor_id)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingestion counters: 'error' events are errors, 'signup' pauses, the rest records of the families."""
    family = (
        F.when(F.col("event_type") == "error", "errors").when(F.col("event_type") == "signup", "pauses")
        .when(F.col("event_type") == "click", "comments").when(F.col("event_type") == "purchase", "articles").otherwise("posts")
    )
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), k % 10).alias("platform"), family.alias("family"), F.lit(1).cast("long").alias("n"), "ts"
    )


INGESTED = """
ingested AS (
  SELECT 'p' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS platform,
         CASE event_type WHEN 'error' THEN 'errors' WHEN 'signup' THEN 'pauses' WHEN 'click' THEN 'comments'
                         WHEN 'purchase' THEN 'articles' ELSE 'posts' END AS family,
         1::BIGINT AS n, ts
  FROM events)"""

# White space as Java's Unicode class sees it, for word splits in SQL.
WHITE = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WHITE}'), lambda w: w <> '')"
