"""Actors and interaction edges from posts.

Posts (flat content): content_id, platform, content_type, created_at, actor_id, parent_id, root_id, mentions,
forwarded_from. Interactions: src, dst, edge_type, ts, platform, narrative_id, content_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import actor_uuid
from talewind.functions.times import micros
from talewind.operators.skew import SLICE, top_per_group, with_previous
from talewind.schemas import DIRECTED_EDGES, UNDIRECTED_EDGES

LOOKBACK_DAYS = 7
AUTHORS_PER_NARRATIVE = 100
DAY_US = 86_400_000_000


def build_actors(content: DataFrame) -> DataFrame:
    """One row per account: first and last seen, posts, latest known followers and display name, and username,
    biography and verification as first seen. ``content``: platform, platform_content_id, created_at, actor."""
    at = F.struct("created_at", "platform_content_id")

    def last_known(field: str) -> Column:
        return F.max_by(F.col(f"actor.{field}"), F.when(F.col(f"actor.{field}").isNotNull(), at)).alias(field)

    def first_seen(field: str) -> Column:
        return F.min_by(F.col(f"actor.{field}"), at).alias(field)

    grouped = content.groupBy("platform", F.col("actor.platform_id").alias("platform_id")).agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.count("*").alias("content_count"), last_known("follower_count"), last_known("display_name"),
        first_seen("username"), first_seen("bio"), first_seen("is_verified"),
    )
    name = F.coalesce("username", "platform_id")
    return grouped.withColumn("username", name).select(
        actor_uuid("platform", "platform_id").alias("actor_id"), F.col("platform").alias("primary_platform"), "platform_id",
        "username", "display_name", "bio", "is_verified", "follower_count", "first_seen", "last_seen", "content_count",
    )


def merge_actors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Actor table after another batch: the same rules across the two tables."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    first = F.struct("first_seen", "_age")
    last = F.struct("last_seen", "_age")

    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), last)).alias(c)

    return both.groupBy("actor_id").agg(
        *[F.min_by(c, first).alias(c) for c in ("primary_platform", "platform_id", "username")],
        last_known("display_name"),
        *[F.min_by(c, first).alias(c) for c in ("bio", "is_verified")],
        last_known("follower_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("content_count").alias("content_count"),
    )


def resolve_author(wanted: DataFrame, posts: DataFrame, reference: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows of ``wanted`` with ``target``: the author of the post named by ``reference``, on the same platform, not
    later and at most ``days`` earlier. Rows without such an author are left out."""
    authors = posts.select(
        F.col("platform").alias("_platform"), F.col("content_id").alias("_content"), F.col("actor_id").alias("target"),
        F.col("created_at").alias("_at"),
    )
    age = micros("created_at") - micros("_at")
    same = (F.col("platform") == F.col("_platform")) & (F.col(reference) == F.col("_content"))
    found = wanted.filter(F.col(reference).isNotNull()).join(authors, same)
    return found.filter((age >= 0) & (age <= days * DAY_US)).drop("_platform", "_content", "_at")


def resolve_parent_author(posts: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    return resolve_author(posts, posts, "parent_id", days)


def _interaction(df: DataFrame, edge_type: Column | str) -> DataFrame:
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    narrative = F.col("narrative_id") if "narrative_id" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col("actor_id").alias("src"), F.col("target").alias("dst"), kind.alias("edge_type"),
        F.col("created_at").alias("ts"), "platform", narrative.alias("narrative_id"), "content_id",
    ).filter(F.col("src") != F.col("dst"))


def reply_edges(posts: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """REPLIED_TO the author of the parent, and of the root where that is another post.

    Reposts and quotes name their source as parent too; they have edges of their own (``repost_quote_edges``).
    """
    answers = posts.filter(~F.col("content_type").isin("repost", "quote"))
    deep = answers.filter(F.col("root_id").isNotNull() & ~F.col("root_id").eqNullSafe(F.col("parent_id")))
    parent = resolve_author(answers, posts, "parent_id", days)
    root = resolve_author(deep, posts, "root_id", days)
    return _interaction(parent, "REPLIED_TO").unionByName(_interaction(root, "REPLIED_TO"))


def repost_quote_edges(posts: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """REPOSTED / QUOTED the author of the parent."""
    shared = posts.filter(F.col("content_type").isin("repost", "quote"))
    kind = F.when(F.col("content_type") == "repost", "REPOSTED").otherwise("QUOTED")
    return _interaction(resolve_author(shared, posts, "parent_id", days), kind)


def mention_edges(posts: DataFrame) -> DataFrame:
    """MENTIONED every account named."""
    named = posts.withColumn("_name", F.explode("mentions")).withColumn("target", actor_uuid("platform", "_name"))
    return _interaction(named, "MENTIONED")


def forward_edges(posts: DataFrame) -> DataFrame:
    """FORWARDED_FROM the channel a message came from."""
    passed = posts.filter(F.coalesce("forwarded_from", F.lit("")) != "")
    target = passed.withColumn("platform", F.lit("telegram")).withColumn("target", actor_uuid("platform", "forwarded_from"))
    return _interaction(target, "FORWARDED_FROM")


def stub_actors(posts: DataFrame) -> DataFrame:
    """Accounts known only from mentions and forwards, with no posts of their own."""
    named = posts.select("platform", F.explode("mentions").alias("platform_id"), "created_at")
    origins = posts.filter(F.coalesce("forwarded_from", F.lit("")) != "").select(
        F.lit("telegram").alias("platform"), F.col("forwarded_from").alias("platform_id"), "created_at"
    )
    seen = named.unionByName(origins).groupBy("platform", "platform_id").agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    return seen.select(
        actor_uuid("platform", "platform_id").alias("actor_id"), F.col("platform").alias("primary_platform"), "platform_id",
        F.col("platform_id").alias("username"), "first_seen", "last_seen", F.lit(0).cast("long").alias("content_count"),
    )


def with_stubs(actors: DataFrame, stubs: DataFrame) -> DataFrame:
    fresh = stubs.join(actors.select("actor_id"), "actor_id", "left_anti")
    return actors.unionByName(fresh, allowMissingColumns=True)


def interactions(posts: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    return (
        reply_edges(posts, days).unionByName(repost_quote_edges(posts, days))
        .unionByName(mention_edges(posts)).unionByName(forward_edges(posts))
    )


def merge_edges(events: DataFrame, width: int = SLICE) -> DataFrame:
    """One edge per (src, dst, type). The weight starts at 1 and grows by 1 / (1 + whole days since the last
    interaction). Platforms are a set (their number is fixed); narratives are counted, see ``edge_narratives``."""
    keys = ["src", "dst", "edge_type"]
    timed = events.filter(F.col("src") != F.col("dst")).withColumn("_us", micros("ts"))
    gaps = with_previous(timed, keys, "_us", ["_us", "content_id"], {"_prev": "_us"}, width)
    days = F.floor((F.col("_us") - F.col("_prev")) / DAY_US)
    gain = F.when(F.col("_prev").isNull(), 1.0).otherwise(1.0 / (1.0 + days))
    return gaps.groupBy(*keys).agg(
        F.sum(gain).alias("weight"), F.count("*").alias("interaction_count"),
        F.min("ts").alias("first_interaction"), F.max("ts").alias("last_interaction"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
    )


def counted_edges(events: DataFrame) -> DataFrame:
    """The edges of ``merge_edges`` and their interaction_count, for those who don't need weights: one aggregation, and nothing is
    ordered or written."""
    return events.filter(F.col("src") != F.col("dst")).groupBy("src", "dst", "edge_type").agg(F.count("*").alias("interaction_count"))


def edge_narratives(events: DataFrame) -> DataFrame:
    """Narratives an edge was seen in, long form."""
    known = events.filter(F.col("narrative_id").isNotNull() & (F.col("src") != F.col("dst")))
    return known.select("src", "dst", "edge_type", "narrative_id").distinct()


def narrative_authors(participation: DataFrame, actors: DataFrame, limit: int = AUTHORS_PER_NARRATIVE) -> DataFrame:
    """The most active accounts of each narrative. ``participation``: narrative_id, actor_id; ``actors``: actor_id,
    content_count."""
    taking_part = participation.select("narrative_id", "actor_id").distinct().join(
        actors.select("actor_id", "content_count"), "actor_id"
    )
    return top_per_group(taking_part, ["narrative_id"], [F.desc("content_count"), F.asc("actor_id")], limit)


def co_narrative_edges(authors: DataFrame) -> DataFrame:
    """Accounts that are among the top authors of the same narratives: weight 1 plus 0.1 per further narrative.

    ``authors`` is the output of ``narrative_authors``: the top list bounds a narrative to limit * (limit - 1) / 2
    pairs whatever its size.
    """
    a = authors.select("narrative_id", F.col("actor_id").alias("src"))
    b = authors.select("narrative_id", F.col("actor_id").alias("dst"))
    pairs = a.join(b, "narrative_id").filter(F.col("src") < F.col("dst"))
    shared = pairs.groupBy("src", "dst").agg(F.count("*").alias("interaction_count"))
    return shared.select(
        "src", "dst", F.lit("CO_NARRATIVE").alias("edge_type"), "interaction_count",
        (1.0 + 0.1 * (F.col("interaction_count") - 1)).alias("weight"),
    )


def graph_projection(edges: DataFrame) -> DataFrame:
    """Edges of the analytics graph: six types with weight, the undirected one in both directions."""
    columns = ["src", "dst", "edge_type", "weight"]
    known = edges.filter(F.col("edge_type").isin(*DIRECTED_EDGES, *UNDIRECTED_EDGES)).select(*columns)
    back = known.filter(F.col("edge_type").isin(*UNDIRECTED_EDGES)).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight"
    )
    return known.unionByName(back)


def amplification_score(edges: DataFrame) -> DataFrame:
    """Reposts, quotes and forwards received."""
    passed = edges.filter(F.col("edge_type").isin("REPOSTED", "QUOTED", "FORWARDED_FROM"))
    return passed.groupBy(F.col("dst").alias("actor_id")).agg(F.sum("interaction_count").alias("amplification_score"))
