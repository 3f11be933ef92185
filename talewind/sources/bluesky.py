"""Posts of Bluesky. Columns: uri, cid, author struct(did, handle, displayName, description, labels), record
struct(text, createdAt, langs, reply struct(parent struct(uri), root struct(uri)), facets array(struct(features
array(struct(type, tag)))), embed struct(type, images array(struct(image struct(ref struct(link)))))), likeCount,
repostCount, replyCount, quoteCount, labels array(struct(val)). The ``$`` of ``$type`` and ``$link`` is dropped on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import blank_to_null, present
from talewind.functions.times import AsOf, parse_iso_ts
from talewind.sources.record import actor, as_content, engagement

# Type names of the protocol.
RECORD_EMBED = "app.bsky.embed.record"
TAG_FEATURE = "app.bsky.richtext.facet#tag"


def content_type_of(record: Column) -> Column:
    return F.when(record["reply"].isNotNull(), "reply").when(record["embed"]["type"].contains(RECORD_EMBED), "quote").otherwise("post")


def facet_tags(facets: Column) -> Column:
    features = F.flatten(F.transform(facets, lambda f: F.coalesce(f["features"], F.expr("array()").cast("array<struct<type:string,tag:string>>"))))
    return present(F.transform(F.filter(features, lambda f: f["type"] == TAG_FEATURE), lambda f: f["tag"]))


def normalize_bluesky(posts: DataFrame, as_of: AsOf) -> DataFrame:
    record, author = F.col("record"), F.col("author")
    uri, cid = F.coalesce("uri", F.lit("")), F.coalesce("cid", F.lit(""))
    did, handle = F.coalesce(author["did"], F.lit("")), F.coalesce(author["handle"], F.lit(""))
    profile = F.concat(F.lit("https://bsky.app/profile/"), handle)
    tail = F.when(uri.contains("/"), F.substring_index(uri, "/", -1)).otherwise(cid)
    refs = present(F.transform(record["embed"]["images"], lambda i: i["image"]["ref"]["link"]))
    images = F.transform(
        refs, lambda ref: F.concat(F.lit("https://cdn.bsky.app/img/feed_thumbnail/plain/"), did, F.lit("/"), ref, F.lit("@jpeg"))
    )
    return as_content(
        posts, as_of, "bluesky",
        content_type=content_type_of(record),
        platform_content_id=F.coalesce(blank_to_null(uri), cid),
        created_at=parse_iso_ts(record["createdAt"], as_of),
        text=blank_to_null(record["text"]),
        url=F.concat(profile, F.lit("/post/"), tail),
        media_urls=F.when(did != "", images),
        language=F.get(record["langs"], F.lit(0)),
        parent_id=record["reply"]["parent"]["uri"],
        root_id=record["reply"]["root"]["uri"],
        conversation_id=record["reply"]["root"]["uri"],
        actor=actor(
            platform_id=did,
            username=handle,
            display_name=F.coalesce(author["displayName"], handle),
            is_verified=F.coalesce(F.size(author["labels"]) > 0, F.lit(False)),
            profile_url=profile,
            bio=author["description"],
        ),
        engagement=engagement(
            likes=F.col("likeCount"), shares=F.col("repostCount"), replies=F.col("replyCount"), quotes=F.col("quoteCount")
        ),
        hashtags=facet_tags(record["facets"]),
        raw_payload=F.to_json(
            F.struct(
                "uri", "cid", did.alias("author_did"), record["embed"]["type"].alias("embed_type"),
                F.transform("labels", lambda label: label["val"]).alias("labels"),
            )
        ),
    )
