"""Image board posts. Columns: board, thread_no, no, resto, com, sub, name, trip, id, time, replies, country,
country_name, tim, ext, capcode, filename, fsize, md5, w, h, sticky, closed, archived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import anon_id
from talewind.functions.text import backlinks, blank_to_null, clean_comment_html
from talewind.functions.times import AsOf, parse_epoch_ts
from talewind.schemas import GEO
from talewind.sources.record import actor, as_content, engagement, typed_struct

ANONYMOUS = "Anonymous"


def normalize_4chan(posts: DataFrame, as_of: AsOf) -> DataFrame:
    """Opening posts become posts, answers become comments below the first post they quote, else below the thread."""
    df = posts.withColumn("_text", clean_comment_html("com"))
    number, thread = F.col("no").cast("string"), F.col("thread_no").cast("string")
    opening = F.col("no") == F.col("thread_no")
    links = backlinks("_text")
    name = F.coalesce(blank_to_null("name"), F.lit(ANONYMOUS))
    trip = blank_to_null("trip")
    country = blank_to_null("country")
    image = F.concat(F.lit("https://i.4cdn.org/"), F.col("board"), F.lit("/"), F.col("tim").cast("string"), F.col("ext"))
    return as_content(
        df, as_of, "4chan",
        content_type=F.when(opening, "post").otherwise("comment"),
        platform_content_id=number,
        created_at=parse_epoch_ts("time"),
        text=F.col("_text"),
        title=blank_to_null("sub"),
        url=F.concat(F.lit("https://boards.4chan.org/"), F.col("board"), F.lit("/thread/"), thread, F.lit("#p"), number),
        media_urls=F.when(F.coalesce(F.col("tim"), F.lit(0)) != 0, F.array(image)),
        parent_id=F.coalesce(F.get(links, F.lit(0)), F.when(~opening, thread)),
        root_id=thread,
        conversation_id=thread,
        actor=actor(
            platform_id=F.coalesce(trip, anon_id(name, F.col("id"))),
            username=F.coalesce(trip, name),
            display_name=F.when(name != ANONYMOUS, name),
        ),
        engagement=engagement(replies=F.when(opening, F.col("replies"))),
        geo=F.when(country.isNotNull(), typed_struct(GEO, {"country_code": country})),
        raw_payload=F.to_json(
            F.struct(
                "board", "thread_no", F.col("no").alias("post_no"), opening.alias("is_op"), trip.alias("trip"), "capcode",
                "country", "country_name", F.col("id").alias("poster_id"), "filename", F.col("ext").alias("file_ext"),
                F.col("fsize").alias("file_size"), F.col("md5").alias("file_md5"), F.col("w").alias("image_width"),
                F.col("h").alias("image_height"), links.alias("backlinks"),
                *[(F.coalesce(F.col(c), F.lit(0)) != 0).alias(c) for c in ("sticky", "closed", "archived")],
            )
        ),
    )
