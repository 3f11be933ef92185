"""Forum posts and comments of Reddit.

``posts``: id, title, selftext, author struct(name, created_utc, has_verified_email), score, num_comments,
num_crossposts, view_count, created_utc, permalink, url, subreddit, upvote_ratio, is_gallery, is_video,
media_metadata map(id -> struct(status, s struct(u))), media struct(reddit_video struct(fallback_url)), ...
``comments``: id, submission_id, body, author, score, created_utc, permalink, parent_id, depth, n_replies, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import strip, user_mentions
from talewind.functions.times import AsOf, parse_epoch_ts
from talewind.operators.skew import top_per_group
from talewind.sources.record import actor, as_content, engagement

# Endings of direct image links.
IMAGE_ENDINGS = r"\.(jpg|jpeg|png|gif|webp)$"
SITE = "https://reddit.com"
DELETED = "[deleted]"


def media_urls() -> Column:
    """Direct image link, valid gallery items, fallback of a hosted video."""
    direct = F.when(F.col("url").rlike(IMAGE_ENDINGS), F.array("url"))
    valid = F.filter(F.map_values("media_metadata"), lambda m: m["status"] == "valid")
    gallery = F.when(F.col("is_gallery"), F.transform(valid, lambda m: F.replace(m["s"]["u"], F.lit("&amp;"), F.lit("&"))))
    video = F.when(F.col("is_video"), F.array(F.col("media.reddit_video.fallback_url")))
    nothing = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(part, nothing) for part in (direct, gallery, video)])


def _author(with_age: bool) -> Column:
    name = F.coalesce(F.col("author.name"), F.lit(DELETED))
    given = {
        "platform_id": name,
        "username": name,
        "is_verified": F.coalesce(F.col("author.has_verified_email"), F.lit(False)),
        "profile_url": F.when(name != DELETED, F.concat(F.lit(f"{SITE}/user/"), name)),
    }
    if with_age:
        created = F.col("author.created_utc")
        given["account_created_at"] = F.when(created.isNotNull(), parse_epoch_ts(created))
    return actor(**given)


def _bare_id(c: str) -> Column:
    """Ids without the type prefix the public API puts before them."""
    return F.regexp_replace(F.col(c), r"^t[13]_", "")


def normalize_reddit_posts(posts: DataFrame, as_of: AsOf) -> DataFrame:
    title, body = F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))
    text = F.when(body != "", strip(F.concat(title, F.lit("\n\n"), body))).otherwise(title)
    return as_content(
        posts, as_of, "reddit",
        content_type=F.lit("post"),
        platform_content_id=F.col("id"),
        created_at=parse_epoch_ts("created_utc"),
        text=text,
        title=title,
        url=F.concat(F.lit(SITE), F.col("permalink")),
        media_urls=media_urls(),
        root_id=F.col("id"),
        conversation_id=F.col("id"),
        actor=_author(with_age=True),
        engagement=engagement(
            likes=F.col("score"), replies=F.col("num_comments"), views=F.col("view_count"), quotes=F.col("num_crossposts")
        ),
        mentions=F.transform(user_mentions(text), lambda m: F.substr(m, F.lit(3))),
        raw_payload=F.to_json(
            F.struct("subreddit", "upvote_ratio", "is_self", "link_flair_text", "over_18", "spoiler", "stickied", "domain")
        ),
    )


def normalize_reddit_comments(comments: DataFrame, as_of: AsOf, per_post: int | None = None) -> DataFrame:
    """Comments below their post. ``per_post`` is a client's bound of comments read per post, newest first; all by default."""
    if per_post is not None:
        order = [F.desc_nulls_last("created_utc"), F.asc("id")]
        comments = top_per_group(comments, ["submission_id"], order, per_post, rank="_rank")
    body = F.coalesce("body", F.lit(""))
    return as_content(
        comments, as_of, "reddit",
        content_type=F.lit("comment"),
        platform_content_id=F.col("id"),
        created_at=parse_epoch_ts("created_utc"),
        text=body,
        url=F.concat(F.lit(SITE), F.col("permalink")),
        parent_id=_bare_id("parent_id"),
        root_id=F.col("submission_id"),
        conversation_id=F.col("submission_id"),
        actor=_author(with_age=False),
        engagement=engagement(likes=F.col("score"), replies=F.col("n_replies")),
        mentions=F.transform(user_mentions(body), lambda m: F.substr(m, F.lit(3))),
        raw_payload=F.to_json(F.struct("depth", "is_submitter", "controversiality", "distinguished", "stickied")),
    )
