"""Identity links between sample customers ("twitter") and suppliers ("reddit")."""

from __future__ import annotations

from pyspark.sql import functions as F

from talewind.operators import identity as idn
from talewind.plans.catalog import query
from talewind.plans.tables import table


def _actors(spark, sf_dir):
    """Names carry the number; hours and topics follow number, balance and nation; some suppliers name a customer."""
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("actor_id"), F.lit("twitter").alias("primary_platform"), F.concat(F.lit("u_"), "c_custkey").alias("username"),
        F.lit(None).cast("string").alias("bio"), F.col("c_custkey").alias("_k"), F.col("c_nationkey").alias("_n"), F.lower("c_mktsegment").alias("_t"),
    )
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("actor_id"), F.lit("reddit").alias("primary_platform"),
        F.when(k % 2 == 0, F.concat(F.lit("U_"), k)).otherwise(F.concat(F.lit("@u"), k)).alias("username"),
        F.when(k % 3 == 0, F.concat(F.lit("me: Twitter.com/U_"), k)).when(k % 3 == 1, F.concat(F.lit("also u_"), k + 1, F.lit(" there"))).alias("bio"),
        k.alias("_k"), F.col("s_nationkey").alias("_n"), F.lit("furniture").alias("_t"),
    )
    both = c.unionByName(s)
    hours = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("_k") + i) % 24).cast("int"))
    return both.select(
        "actor_id", "primary_platform", "username", "bio", hours.alias("active_hours"),
        F.array(F.col("_t"), F.concat(F.lit("n"), (F.col("_n") % 4).cast("string"))).alias("primary_topics"),
    )


ACTORS = """
actors AS (
  SELECT 'c' || c_custkey AS actor_id, 'twitter' AS platform, 'u_' || c_custkey AS username, NULL AS bio, c_custkey AS k,
         [lower(c_mktsegment), 'n' || (c_nationkey % 4)] AS topics FROM customer
  UNION ALL
  SELECT 's' || s_suppkey, 'reddit', CASE WHEN s_suppkey % 2 = 0 THEN 'U_' || s_suppkey ELSE '@u' || s_suppkey END,
         CASE s_suppkey % 3 WHEN 0 THEN 'me: Twitter.com/U_' || s_suppkey WHEN 1 THEN 'also u_' || (s_suppkey + 1) || ' there' END, s_suppkey,
         ['furniture', 'n' || (s_nationkey % 4)] FROM supplier),
hrs AS (SELECT *, list_transform(range(6), lambda i: (k + i) % 24) AS hours FROM actors),
by_name AS (
  SELECT a.actor_id AS actor_a, b.actor_id AS actor_b FROM actors a JOIN actors b
  ON lower(a.username) = lower(b.username) AND a.platform <> b.platform AND a.actor_id < b.actor_id),
by_bio AS (
  SELECT DISTINCT least(a.actor_id, b.actor_id) AS actor_a, greatest(a.actor_id, b.actor_id) AS actor_b FROM actors a JOIN actors b
  ON a.platform <> b.platform AND a.bio IS NOT NULL AND (
    regexp_matches(lower(a.bio), '(^|[^\\w.\\-])' || trim(lower(b.username), '@') || '($|[^\\w.\\-])')
    OR (contains(lower(a.bio), b.platform) AND replace(trim(lower(a.username), '@'), '_', '') = replace(trim(lower(b.username), '@'), '_', '')))),
cand AS (SELECT * FROM by_name UNION SELECT * FROM by_bio)"""


@query("candidates_by_username", f"WITH {ACTORS} SELECT * FROM by_name")
def by_username(spark, sf_dir):
    return idn.candidates_by_username(_actors(spark, sf_dir))


@query("candidates_by_bio", f"WITH {ACTORS} SELECT * FROM by_bio")
def by_bio(spark, sf_dir):
    return idn.candidates_by_bio(_actors(spark, sf_dir))


MENTIONS = """
mentions AS (
  SELECT DISTINCT least(a.actor_id, b.actor_id) AS actor_a, greatest(a.actor_id, b.actor_id) AS actor_b FROM actors a JOIN actors b
  ON a.platform <> b.platform AND contains(lower(a.bio), lower(b.username)))"""


@query("candidates_by_mention", f"WITH {ACTORS}, {MENTIONS} SELECT * FROM mentions")
def by_mention(spark, sf_dir):
    return idn.candidates_by_mention(_actors(spark, sf_dir))


@query(
    "platform_mentions",
    f"""WITH {ACTORS} SELECT DISTINCT a.actor_id, p.platform FROM actors a JOIN (SELECT DISTINCT platform FROM actors) p
    ON p.platform <> a.platform AND contains(lower(a.bio), p.platform)""",
)
def platform_mentions(spark, sf_dir):
    return idn.platform_mentions(_actors(spark, sf_dir))


@query(
    "mentioned_pairs",
    f"""WITH {ACTORS}, {MENTIONS} SELECT actor_a, actor_b FROM mentions JOIN actors a ON a.actor_id = actor_a JOIN actors b ON b.actor_id = actor_b
    WHERE contains(lower(a.bio), b.platform) OR contains(lower(b.bio), a.platform)""",
)
def mentioned_pairs(spark, sf_dir):
    actors = _actors(spark, sf_dir)
    return idn.mentioned_pairs(idn.candidates_by_mention(actors), actors)


def _candidates(spark, sf_dir):
    actors = _actors(spark, sf_dir)
    return actors, idn.candidate_pairs(idn.candidates_by_username(actors), idn.candidates_by_bio(actors))


@query("candidate_pairs", f"WITH {ACTORS} SELECT * FROM cand")
def pairs(spark, sf_dir):
    return _candidates(spark, sf_dir)[1]


@query(
    "fuzzy_candidates",
    f"""WITH {ACTORS} SELECT a.actor_id AS actor_a, b.actor_id AS actor_b FROM actors a JOIN actors b
    ON regexp_replace(trim(lower(a.username), '@'), '[_.-]', '', 'g') = regexp_replace(trim(lower(b.username), '@'), '[_.-]', '', 'g')
    AND a.platform <> b.platform AND a.actor_id < b.actor_id""",
)
def fuzzy(spark, sf_dir):
    return idn.fuzzy_candidates(_actors(spark, sf_dir))


def _hashes(spark, sf_dir):
    """Brands and sizes of what an account ordered or supplied stand for its texts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("_text"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    ends = F.explode(F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")))
    # Hashes are several times as long as what they stand for, so they are made of distinct texts.
    return sold.select(ends.alias("actor_id"), "_text").distinct().select("actor_id", F.sha2("_text", 256).alias("hash"))


HASHES = """
sold AS (SELECT o_custkey, l_suppkey, sha256(p_brand || '|' || p_size) AS hash FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
hashes AS (SELECT DISTINCT 'c' || o_custkey AS actor_id, hash FROM sold UNION SELECT DISTINCT 's' || l_suppkey, hash FROM sold),
shared AS (SELECT actor_a, actor_b, count(*) AS shared_hashes FROM cand JOIN hashes x ON x.actor_id = actor_a JOIN hashes y ON y.actor_id = actor_b AND y.hash = x.hash GROUP BY ALL)"""


@query("content_fingerprints", f"WITH {ACTORS}, {HASHES} SELECT * FROM shared")
def fingerprints(spark, sf_dir):
    return idn.content_fingerprints(_candidates(spark, sf_dir)[1], _hashes(spark, sf_dir))


SCORES = """
sides AS (
  SELECT c.*, a.platform AS pa, b.platform AS pb, trim(lower(a.username), '@') AS na, trim(lower(b.username), '@') AS nb, a.bio AS ba, b.bio AS bb,
         a.hours AS ha, b.hours AS hb, a.topics AS ta, b.topics AS tb, coalesce(shared_hashes, 0) AS sh
  FROM cand c JOIN hrs a ON a.actor_id = c.actor_a JOIN hrs b ON b.actor_id = c.actor_b LEFT JOIN shared s ON s.actor_a = c.actor_a AND s.actor_b = c.actor_b),
methods AS (
  SELECT actor_a, actor_b,
    CASE WHEN na = nb THEN 0.60 WHEN replace(na, '_', '') = replace(nb, '_', '') THEN 0.45 WHEN levenshtein(na, nb) <= 2 THEN 0.35 ELSE 0 END::DOUBLE AS m1,
    CASE WHEN pa = 'twitter' AND bb IS NOT NULL AND lower(regexp_extract(bb, '(?i)twitter\\.com/(\\w+)', 1)) = na THEN 0.90 ELSE 0 END::DOUBLE AS m2,
    CASE WHEN sh > 0 THEN least(0.80, 0.40 + sh * 0.10) ELSE 0 END::DOUBLE AS m3,
    0.4 * (0.4 * len(list_intersect(ha, hb)) / len(list_distinct(list_concat(ha, hb))) + 0.6 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))))::DOUBLE AS m4
  FROM sides),
total AS (SELECT *, 1 - (1 - m1) * (1 - m2) * (1 - m3) * (1 - m4) AS c FROM methods)"""


@query(
    "score_pairs",
    f"""WITH {ACTORS}, {HASHES}, {SCORES} SELECT actor_a, actor_b, m1 AS username_matching, m2 AS bio_cross_reference, round(m3, 9) AS content_fingerprinting,
      round(m4, 9) AS behavioral_fingerprinting FROM methods""",
)
def score_pairs(spark, sf_dir):
    actors, cand = _candidates(spark, sf_dir)
    found = idn.score_pairs(cand, actors, _hashes(spark, sf_dir))
    return found.select(
        "actor_a", "actor_b", "username_matching", "bio_cross_reference", F.round("content_fingerprinting", 9).alias("content_fingerprinting"),
        F.round("behavioral_fingerprinting", 9).alias("behavioral_fingerprinting"),
    )


def _links(spark, sf_dir):
    actors, cand = _candidates(spark, sf_dir)
    return idn.score_identity(cand, actors, _hashes(spark, sf_dir))


@query("score_identity", f"WITH {ACTORS}, {HASHES}, {SCORES} SELECT actor_a, actor_b, round(c, 4) AS confidence, "
       "(m1 > 0)::INT + (m2 > 0)::INT + (round(m3, 4) > 0)::INT + (round(m4, 4) > 0)::INT AS methods FROM total WHERE c >= 0.70")
def score_identity(spark, sf_dir):
    return _links(spark, sf_dir).select("actor_a", "actor_b", "confidence", F.size("methods").alias("methods"))


@query("link_edges", f"WITH {ACTORS}, {HASHES}, {SCORES} SELECT actor_a AS src, actor_b AS dst, 'SAME_PERSON' AS edge_type, round(c, 4) AS confidence FROM total WHERE c >= 0.70")
def link_edges(spark, sf_dir):
    return idn.link_edges(_links(spark, sf_dir)).drop("methods")


@query(
    "linked_accounts",
    f"""WITH {ACTORS}, {HASHES}, {SCORES} SELECT round(c, 4) AS confidence, count(*) AS links, count(DISTINCT actor_a) AS accounts
        FROM total JOIN by_name USING (actor_a, actor_b) WHERE c >= 0.7 GROUP BY ALL""",
)
def linked_accounts(spark, sf_dir):
    links, groups = idn.linked_accounts(_actors(spark, sf_dir), _hashes(spark, sf_dir))
    first = links.join(groups.withColumnRenamed("actor_id", "_a"), F.col("actor_a") == F.col("head")).groupBy("confidence").agg(F.countDistinct("_a").alias("accounts"))
    return links.groupBy("confidence").agg(F.sum(F.col("accounts_a") * F.col("accounts_b")).alias("links")).join(first, "confidence")
