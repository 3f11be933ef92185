"""News and newsletter feed entries with the text of the linked article.

Columns: feed_name, id, link, title, summary, author, published, updated, language, enclosures array(struct(href)),
media_content array(struct(url)), tags array(struct(term)), article struct(text, title, author, sitename, language,
description, categories, tags); ``article`` is null where the page was not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.text import blank_to_null, present
from talewind.functions.times import AsOf, parse_entry_ts
from talewind.sources.record import actor, as_content


def _common(as_of: AsOf) -> dict[str, Column]:
    link = F.coalesce("link", F.lit(""))
    nothing = F.array().cast("array<string>")
    files = F.concat(
        F.coalesce(F.transform("enclosures", lambda e: e["href"]), nothing),
        F.coalesce(F.transform("media_content", lambda m: m["url"]), nothing),
    )
    return {
        "content_type": F.lit("article"),
        "platform_content_id": F.coalesce(F.col("id"), link),
        "created_at": parse_entry_ts("published", "updated", as_of),
        "text": F.coalesce(blank_to_null("article.text"), "summary", F.lit("")),
        "title": F.coalesce(blank_to_null("article.title"), "title", F.lit("")),
        "url": link,
        "media_urls": files,
        "language": F.coalesce(blank_to_null("language"), F.col("article.language")),
    }


def _author() -> Column:
    return F.coalesce(blank_to_null("article.author"), "author", "feed_name")


def _site() -> Column:
    return F.coalesce("article.sitename", "feed_name")


def _terms() -> Column:
    return F.transform("tags", lambda t: t["term"])


def normalize_news(entries: DataFrame, as_of: AsOf) -> DataFrame:
    payload = F.struct(
        F.col("feed_name").alias("source_feed"), _terms().alias("categories"),
        F.coalesce("article.description", F.lit("")).alias("description"),
    )
    return as_content(
        entries, as_of, "rss", **_common(as_of),
        actor=actor(platform_id=_site(), username=_author(), display_name=_site()),
        raw_payload=F.to_json(payload),
    )


def normalize_substack(entries: DataFrame, as_of: AsOf) -> DataFrame:
    link = F.coalesce("link", F.lit(""))
    home = F.regexp_replace(link, r"/[^/]*$", "")
    payload = F.struct(
        F.col("feed_name").alias("source_feed"), _site().alias("sitename"),
        *[F.coalesce(f"article.{c}", F.lit("")).alias(a) for c, a in
          (("description", "description"), ("categories", "categories"), ("tags", "rss_tags"))],
    )
    return as_content(
        entries, as_of, "substack", **_common(as_of),
        hashtags=present(_terms()),
        actor=actor(
            platform_id=F.concat(F.lit("substack:"), F.col("feed_name")), username=_author(), display_name=_site(),
            profile_url=home,
        ),
        raw_payload=F.to_json(payload),
    )
