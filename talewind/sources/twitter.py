"""Short messages of Twitter / X, with the author and media side tables of the same read.

``tweets``: id, text, created_at, author_id, conversation_id, in_reply_to_user_id, referenced_tweets
array(struct(type, id)), attachments struct(media_keys), public_metrics struct, entities struct(hashtags, mentions,
urls), lang, source. ``users``: id, name, username, created_at, verified, public_metrics, description.
``media``: media_key, url, preview_image_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import blank_to_null, present
from talewind.functions.times import AsOf, parse_iso_ts
from talewind.sources.record import actor, as_content, engagement

# Kinds of referenced messages and the content type each stands for.
REFERENCE_TYPES = {"replied_to": "reply", "retweeted": "repost", "quoted": "quote"}
# Endings that mark a linked file as media.
MEDIA_ENDINGS = r"\.(jpg|png|gif|mp4|webp)"


def content_type_of(references: Column) -> Column:
    """The first reference of a known kind decides."""
    known = F.filter(references, lambda r: r["type"].isin(*REFERENCE_TYPES))
    first = F.get(known, F.lit(0))["type"]
    kinds = F.create_map(*[F.lit(x) for pair in REFERENCE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, first), F.lit("post"))


def referenced_id(references: Column, kind: str) -> Column:
    fitting = F.filter(references, lambda r: (r["type"] == kind) & (F.coalesce(r["id"].cast("string"), F.lit("")) != ""))
    return F.get(fitting, F.lit(0))["id"].cast("string")


def parent_of(references: Column) -> Column:
    """The message answered; else the one reposted or quoted, so that those edges can be built too."""
    return F.coalesce(*[referenced_id(references, kind) for kind in REFERENCE_TYPES])


def entity_hashtags(entities: Column) -> Column:
    return present(F.transform(entities["hashtags"], lambda h: h["tag"]))


def entity_mentions(entities: Column) -> Column:
    return present(F.transform(entities["mentions"], lambda m: m["username"]))


def _with_media(tweets: DataFrame, media: DataFrame) -> DataFrame:
    """Media links per message, in attachment order."""
    keys = tweets.select("id", F.posexplode("attachments.media_keys").alias("_pos", "media_key"))
    links = media.select("media_key", F.coalesce(blank_to_null("url"), blank_to_null("preview_image_url")).alias("_link"))
    found = (
        keys.join(links.dropDuplicates(["media_key"]), "media_key")
        .groupBy("id")
        # A message has at most a handful of attachments.
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_link"))).alias("_found"))
        .select("id", F.transform("_found", lambda f: f["_link"]).alias("_attached"))
    )
    return tweets.join(found, "id", "left")


def normalize_tweets(tweets: DataFrame, users: DataFrame, media: DataFrame, as_of: AsOf) -> DataFrame:
    people = users.dropDuplicates(["id"]).select(F.col("id").cast("string").alias("_uid"), F.struct("*").alias("_u"))
    joined = _with_media(tweets, media).join(people, F.col("author_id").cast("string") == F.col("_uid"), "left")
    author = F.coalesce(F.col("author_id").cast("string"), F.lit(""))
    name = F.col("_u.username")
    m = F.col("public_metrics")
    linked = F.filter(F.transform("entities.urls", lambda u: u["expanded_url"]), lambda u: u.rlike(MEDIA_ENDINGS))
    nothing = F.array().cast("array<string>")
    root = F.coalesce(F.col("conversation_id").cast("string"), F.col("id").cast("string"))
    return as_content(
        joined, as_of, "twitter",
        content_type=content_type_of(F.col("referenced_tweets")),
        platform_content_id=F.col("id").cast("string"),
        created_at=parse_iso_ts("created_at", as_of),
        text=F.coalesce("text", F.lit("")),
        url=F.concat(F.lit("https://x.com/i/status/"), F.col("id").cast("string")),
        media_urls=F.concat(F.coalesce("_attached", nothing), F.coalesce(linked, nothing)),
        language=F.col("lang"),
        parent_id=parent_of(F.col("referenced_tweets")),
        root_id=root,
        conversation_id=root,
        actor=actor(
            platform_id=author,
            username=F.coalesce(name, author),
            display_name=F.col("_u.name"),
            follower_count=F.col("_u.public_metrics.followers_count"),
            following_count=F.col("_u.public_metrics.following_count"),
            account_created_at=F.try_to_timestamp("_u.created_at"),
            is_verified=F.coalesce(F.col("_u.verified"), F.lit(False)),
            bio=F.col("_u.description"),
            profile_url=F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("https://x.com/"), name)),
        ),
        engagement=engagement(
            likes=m["like_count"], shares=m["retweet_count"], replies=m["reply_count"], views=m["impression_count"],
            quotes=m["quote_count"], bookmarks=m["bookmark_count"],
        ),
        hashtags=entity_hashtags(F.col("entities")),
        mentions=entity_mentions(F.col("entities")),
        raw_payload=F.to_json(F.struct("source", "referenced_tweets", "in_reply_to_user_id")),
    )
