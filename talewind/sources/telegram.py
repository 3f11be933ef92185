"""Channel messages of Telegram. Columns: channel_id, channel_username, channel_title, id, date, text, sender_id,
post_author, views, forwards, n_replies, reactions map(emoticon -> count), reply_to_msg_id, has_photo, has_document,
web_preview_url, grouped_id, edit_date, forward struct(channel_id, from_name, date, channel_post)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.scores import reaction_total
from talewind.functions.text import blank_to_null
from talewind.functions.times import AsOf, instant
from talewind.sources.record import actor, as_content, engagement


def content_type_of() -> Column:
    return F.when(F.col("forward").isNotNull(), "forward").when(F.col("reply_to_msg_id").isNotNull(), "reply").otherwise("post")


def normalize_telegram(messages: DataFrame, as_of: AsOf) -> DataFrame:
    """Parent ids carry the channel prefix of content ids, so that answers find the message they answer."""
    channel = F.col("channel_id").cast("string")
    handle = blank_to_null("channel_username")
    own = F.concat(channel, F.lit(":"), F.col("id").cast("string"))
    parent = F.concat(channel, F.lit(":"), F.col("reply_to_msg_id").cast("string"))
    media = F.array(
        F.when(F.col("has_photo"), F.concat(F.lit("tg://photo/"), F.col("id").cast("string"))),
        F.when(F.col("has_document"), F.concat(F.lit("tg://document/"), F.col("id").cast("string"))),
        F.col("web_preview_url"),
    )
    origin = F.col("forward.channel_id").cast("string")
    return as_content(
        messages, as_of, "telegram",
        content_type=content_type_of(),
        platform_content_id=own,
        created_at=F.coalesce(F.col("date").cast("timestamp"), instant(as_of)),
        text=F.coalesce("text", F.lit("")),
        url=F.when(handle.isNotNull(), F.concat(F.lit("https://t.me/"), handle, F.lit("/"), F.col("id").cast("string"))),
        media_urls=media,
        parent_id=parent,
        root_id=channel,
        conversation_id=F.coalesce(parent, own),
        actor=actor(
            platform_id=F.coalesce(F.col("sender_id"), F.col("channel_id")).cast("string"),
            username=F.coalesce(handle, channel),
            display_name=F.coalesce(blank_to_null("post_author"), F.col("channel_title")),
            profile_url=F.concat(F.lit("https://t.me/"), handle),
        ),
        engagement=engagement(
            likes=reaction_total("reactions"), shares=F.col("forwards"), replies=F.col("n_replies"), views=F.col("views")
        ),
        forwarded_from=F.when(F.col("forward").isNotNull(), origin),
        raw_payload=F.to_json(
            F.struct(
                "channel_id", "channel_username", "reactions", "grouped_id", "edit_date", "post_author",
                origin.alias("forwarded_from_channel_id"), F.col("forward.from_name").alias("forwarded_from_name"),
                F.col("forward.date").alias("forwarded_from_date"), F.col("forward.channel_post").alias("forwarded_from_post_id"),
            )
        ),
    )
