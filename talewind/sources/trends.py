"""Search trends: daily topics, interest over time, rising queries.

``topics``: region, title, formattedTraffic, articles array(struct(title, source, url)), relatedQueries array(string),
day. ``interest``: keyword, region, date, value. ``related``: keyword, region, query, value, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import trend_id
from talewind.functions.text import parse_traffic
from talewind.functions.times import AsOf, instant
from talewind.operators.skew import top_per_group
from talewind.sources.record import actor, as_content, engagement

SOURCE = "google_trends"
PAGE = "https://trends.google.com/trends/explore?q="
RISING = 5


def _page(term: str) -> Column:
    return F.concat(F.lit(PAGE), F.col(term), F.lit("&geo="), F.col("region"))


def _source_actor() -> Column:
    label = F.concat(F.lit("Google Trends ("), F.col("region"), F.lit(")"))
    return actor(platform_id=F.lit(SOURCE), username=F.lit(SOURCE), display_name=label)


def _first(name: str, most: int | None) -> Column:
    return F.col(name) if most is None else F.slice(name, 1, most)


def normalize_trending(
    topics: DataFrame, as_of: AsOf, snippets: int | None = None, queries: int | None = None, articles: int | None = None,
) -> DataFrame:
    """Daily topics. A client's bounds, all off by default: ``snippets`` of articles in the text, ``queries`` and ``articles`` in
    the payload."""
    day = F.date_format(instant(as_of), "yyyy-MM-dd")
    lines = F.transform(
        _first("articles", snippets),
        lambda a: F.concat(
            F.lit("- "), F.coalesce(a["title"], F.lit("")), F.lit(" ("), F.coalesce(a["source"], F.lit("")), F.lit(")")
        ),
    )
    payload = F.struct(
        "region", F.coalesce("formattedTraffic", F.lit("0")).alias("formatted_traffic"),
        _first("relatedQueries", queries).alias("related_queries"),
        _first("articles", articles).alias("articles"), F.lit("daily_trending").alias("source_type"),
    )
    return as_content(
        topics, as_of, "web",
        content_type=F.lit("other"),
        platform_content_id=trend_id("region", "title", day),
        created_at=instant(as_of),
        title=F.concat(F.lit("[Google Trends] "), F.col("title")),
        text=F.when(F.size("articles") > 0, F.array_join(lines, "\n")),
        url=_page("title"),
        language=F.lit("en"),
        actor=_source_actor(),
        engagement=engagement(views=parse_traffic(F.coalesce("formattedTraffic", F.lit("0")))),
        raw_payload=F.to_json(payload),
    )


def latest_interest(interest: DataFrame) -> DataFrame:
    """Last data point per keyword and region."""
    return interest.groupBy("keyword", "region").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def rising_queries(related: DataFrame, as_of: AsOf, k: int = RISING) -> DataFrame:
    """First ``k`` rising queries per keyword, as interest points named ``keyword -> query``."""
    top = top_per_group(related, ["keyword", "region"], [F.asc("position"), F.asc("query")], k)
    return top.select(
        F.concat_ws(" -> ", "keyword", "query").alias("keyword"), "region", F.to_date(instant(as_of)).alias("date"),
        F.col("value"),
    )


def normalize_interest(interest: DataFrame, as_of: AsOf) -> DataFrame:
    day, value = F.col("date").cast("string"), F.col("value").cast("long")
    text = F.concat(
        F.lit("Interest score "), value.cast("string"), F.lit("/100 for '"), F.col("keyword"), F.lit("' in "), F.col("region")
    )
    payload = F.struct(
        "region", "keyword", value.alias("interest_value"), day.alias("date"), F.lit("interest_over_time").alias("source_type")
    )
    return as_content(
        interest, as_of, "web",
        content_type=F.lit("other"),
        platform_content_id=trend_id("region", "keyword", day),
        created_at=instant(as_of),
        title=F.concat(F.lit("[Google Trends Interest] "), F.col("keyword")),
        text=text,
        url=_page("keyword"),
        language=F.lit("en"),
        actor=_source_actor(),
        engagement=engagement(views=value),
        raw_payload=F.to_json(payload),
    )
