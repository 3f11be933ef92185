"""Synthetic valid records for tests: every value is a hash of (row number, seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talewind.functions.times import AsOf, instant
from talewind.schemas import CONTENT, CONTENT_TYPES, NLP, PLATFORMS, SENTIMENTS
from talewind.sources.record import ARRAYS, actor, engagement, typed_struct

WORDS = ("alpha", "breeze", "cedar", "delta", "ember", "frost", "grove", "harbor", "island", "juniper", "kelp", "lumen")


def generate_content(
    spark: SparkSession, n: int, seed: int = 0, as_of: AsOf = "2024-06-01", people: int = 1000
) -> DataFrame:
    def number(label: str, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(label)), F.lit(below))

    def pick(label: str, values: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), number(label, len(values)))

    def some_words(label: str, most: int) -> Column:
        all_words = F.array(*[F.lit(w) for w in WORDS])
        picks = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.get(all_words, F.pmod(F.xxhash64("id", F.lit(seed), F.lit(label), i), F.lit(len(WORDS)))))
        return F.slice(picks, F.lit(1), number(label, most + 1).cast("int"))

    person = number("person", people).cast("string")
    score = number("score", 2001) / 1000 - 1
    values = {
        "id": F.concat_ws("-", F.lit("gen"), F.lit(seed), F.col("id")),
        "platform": pick("platform", PLATFORMS),
        "content_type": pick("type", CONTENT_TYPES),
        "platform_content_id": F.concat(F.lit("c"), F.col("id")),
        "created_at": instant(as_of) - F.make_dt_interval(secs=number("age", 30 * 86_400)),
        "collected_at": instant(as_of),
        "text": F.array_join(some_words("text", 40), " "),
        "url": F.concat(F.lit("https://example.org/"), F.col("id")),
        "language": F.lit("en"),
        "actor": actor(
            platform_id=person, username=F.concat(F.lit("user_"), person), display_name=F.concat(F.lit("User "), person),
            follower_count=number("followers", 1_000_000), following_count=number("following", 10_000),
            account_created_at=instant(as_of) - F.make_dt_interval(days=(number("since", 1800) + 1).cast("int")),
            is_verified=number("verified", 10) == 0, bio=F.array_join(some_words("bio", 8), " "),
        ),
        "engagement": engagement(
            likes=number("likes", 50_000), shares=number("shares", 10_000), replies=number("replies", 5_000),
            views=number("views", 1_000_000),
        ),
        "nlp": typed_struct(NLP, {
            "language": F.lit("en"), "sentiment": pick("sentiment", SENTIMENTS), "sentiment_score": score,
            "topics": some_words("topics", 3), "keywords": some_words("keywords", 5),
        }),
        "hashtags": F.transform(some_words("tags", 4), lambda w: F.concat(F.lit("#"), w)),
    }
    columns = []
    for field in CONTENT.fields:
        value = values.get(field.name, F.lit(None)).cast(field.dataType)
        if field.name in ARRAYS:
            value = F.coalesce(value, F.array().cast(field.dataType))
        columns.append(value.alias(field.name))
    return spark.range(n).select(*columns)
