"""Videos of YouTube. Columns: id, snippet struct(channelId, channelTitle, publishedAt, title, description, tags,
thumbnails struct(maxres, high, medium, default each struct(url)), defaultAudioLanguage, defaultLanguage, categoryId,
liveBroadcastContent), statistics struct of strings, contentDetails struct(duration, definition), transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import blank_to_null
from talewind.functions.times import AsOf, parse_iso_ts
from talewind.sources.record import actor, as_content, engagement

# Thumbnail sizes, best first.
THUMBNAILS = ("maxres", "high", "medium", "default")


def normalize_youtube(videos: DataFrame, as_of: AsOf, max_tags: int | None = None) -> DataFrame:
    """``max_tags``: a client's bound of tags per video; all by default."""
    snippet, stats = F.col("snippet"), F.col("statistics")
    transcript = F.concat(F.lit("\n[TRANSCRIPT]\n"), blank_to_null("transcript"))
    channel = F.coalesce(snippet["channelId"], F.lit(""))
    title = F.coalesce(snippet["title"], F.lit(""))
    text = F.concat_ws("\n\n", blank_to_null(title), blank_to_null(snippet["description"]), transcript)
    video = F.col("id").cast("string")
    return as_content(
        videos, as_of, "youtube",
        content_type=F.lit("video"),
        platform_content_id=video,
        created_at=parse_iso_ts(snippet["publishedAt"], as_of),
        text=text,
        title=title,
        url=F.concat(F.lit("https://www.youtube.com/watch?v="), video),
        media_urls=F.array(F.coalesce(*[blank_to_null(snippet["thumbnails"][size]["url"]) for size in THUMBNAILS])),
        language=F.coalesce(blank_to_null(snippet["defaultAudioLanguage"]), snippet["defaultLanguage"]),
        root_id=video,
        conversation_id=video,
        actor=actor(
            platform_id=channel,
            username=F.coalesce(snippet["channelTitle"], F.lit("")),
            display_name=F.coalesce(snippet["channelTitle"], F.lit("")),
            profile_url=F.when(channel != "", F.concat(F.lit("https://www.youtube.com/channel/"), channel)),
        ),
        engagement=engagement(
            likes=stats["likeCount"].try_cast("long"), replies=stats["commentCount"].try_cast("long"),
            views=stats["viewCount"].try_cast("long"), bookmarks=stats["favoriteCount"].try_cast("long"),
        ),
        hashtags=snippet["tags"] if max_tags is None else F.slice(snippet["tags"], 1, max_tags),
        raw_payload=F.to_json(
            F.struct(
                snippet["categoryId"].alias("category_id"), F.col("contentDetails.duration").alias("duration"),
                F.col("contentDetails.definition").alias("definition"),
                snippet["liveBroadcastContent"].alias("live_broadcast_content"),
                F.col("transcript").isNotNull().alias("has_transcript"),
            )
        ),
    )
