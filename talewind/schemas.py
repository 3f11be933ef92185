"""Record types shared by sources and operators, and the value lists they are checked against."""

from __future__ import annotations

from pyspark.sql import types as T

# Platform names.
PLATFORMS = (
    "twitter", "reddit", "telegram", "youtube", "tiktok", "facebook", "instagram", "4chan", "gab",
    "truth_social", "rumble", "rss", "web", "bluesky", "substack", "wikipedia", "other",
)
# Content types.
CONTENT_TYPES = (
    "post", "comment", "reply", "repost", "quote", "article", "video", "image", "thread", "forward", "edit", "other",
)
# Narrative states.
NARRATIVE_STATES = ("emerging", "growing", "viral", "peaking", "declining", "dormant", "dead", "resurgent")
# Narrative states that count as active for migrations, for predictions, and as history.
MIGRATING_STATES = ("emerging", "growing", "viral")
ACTIVE_STATES = ("emerging", "growing", "viral", "peaking")
HISTORICAL_STATES = ("dead", "dormant", "declining")
# Sentiments, entity types, severities, briefing types.
SENTIMENTS = ("positive", "negative", "neutral", "mixed")
ENTITY_TYPES = ("person", "organization", "location", "event", "hashtag", "url", "other")
SEVERITIES = ("low", "medium", "high", "critical")
BRIEFING_TYPES = ("daily", "weekly", "on_demand", "alert")
# Signal types that have a detector, plus semantic clones.
SIGNAL_TYPES = (
    "temporal_burst", "posting_regularity", "content_diversity_anomaly", "fresh_account_swarm", "star_topology",
    "semantic_clone",
)
# Raw topic per platform.
RAW_TOPICS = {
    "twitter": "raw.twitter", "reddit": "raw.reddit", "telegram": "raw.telegram", "youtube": "raw.youtube",
    "tiktok": "raw.tiktok", "rss": "raw.rss", "web": "raw.web", "4chan": "raw.4chan", "bluesky": "raw.bluesky",
    "substack": "raw.substack", "wikipedia": "raw.wikipedia",
}
# Edge types, and those with a direction in the analytics graph.
DIRECTED_EDGES = ("REPLIED_TO", "REPOSTED", "QUOTED", "MENTIONED", "FORWARDED_FROM")
UNDIRECTED_EDGES = ("CO_NARRATIVE",)

_s, _l, _d, _b, _t = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ACTOR = _struct(
    platform_id=_s, username=_s, display_name=_s, follower_count=_l, following_count=_l, account_created_at=_t,
    is_verified=_b, bio=_s, profile_url=_s,
)
ENGAGEMENT = _struct(likes=_l, shares=_l, replies=_l, views=_l, quotes=_l, bookmarks=_l)
GEO = _struct(latitude=_d, longitude=_d, country_code=_s, region=_s, city=_s)
ENTITY = _struct(text=_s, entity_type=_s, confidence=_d, start_offset=_l, end_offset=_l)
NLP = _struct(
    language=_s, sentiment=_s, sentiment_score=_d, topics=T.ArrayType(_s), keywords=T.ArrayType(_s),
    entities=T.ArrayType(ENTITY), summary=_s, embedding=T.ArrayType(T.FloatType()),
)
CONTENT = _struct(
    id=_s, platform=_s, content_type=_s, platform_content_id=_s, created_at=_t, collected_at=_t, text=_s, title=_s,
    url=_s, media_urls=T.ArrayType(_s), language=_s, parent_id=_s, root_id=_s, conversation_id=_s, actor=ACTOR,
    engagement=ENGAGEMENT, geo=GEO, nlp=NLP, hashtags=T.ArrayType(_s), mentions=T.ArrayType(_s), forwarded_from=_s,
    narrative_ids=T.ArrayType(_s), raw_payload=_s,
)
