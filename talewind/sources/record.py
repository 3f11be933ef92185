"""Common shape of all source mappings: a ``select`` that yields the content schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talewind.functions.ids import content_uuid
from talewind.functions.text import present
from talewind.functions.times import AsOf, instant
from talewind.schemas import ACTOR, CONTENT, ENGAGEMENT

ARRAYS = ("media_urls", "hashtags", "mentions", "narrative_ids")


def typed_struct(kind: T.StructType, given: dict[str, Column]) -> Column:
    unknown = set(given) - set(kind.fieldNames())
    if unknown:
        raise ValueError(f"not in the record type: {sorted(unknown)}")
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def actor(**given: Column) -> Column:
    given.setdefault("is_verified", F.lit(False))
    return typed_struct(ACTOR, given)


def engagement(**given: Column) -> Column:
    """Counters default to 0; only views may be unknown."""
    filled = {name: F.coalesce(value.cast("long"), F.lit(0)) for name, value in given.items() if name != "views"}
    for name in ENGAGEMENT.fieldNames():
        filled.setdefault(name, F.lit(0))
    filled["views"] = given.get("views", F.lit(None)).cast("long")
    return typed_struct(ENGAGEMENT, filled)


def as_content(df: DataFrame, as_of: AsOf, platform: str, **given: Column) -> DataFrame:
    given["platform"] = F.lit(platform)
    given.setdefault("collected_at", instant(as_of))
    given.setdefault("engagement", engagement())
    given["id"] = content_uuid(F.lit(platform), given["platform_content_id"])
    unknown = set(given) - set(CONTENT.fieldNames())
    if unknown:
        raise ValueError(f"not in the content schema: {sorted(unknown)}")
    columns = []
    for field in CONTENT.fields:
        value = given.get(field.name, F.lit(None)).cast(field.dataType)
        if field.name in ARRAYS:
            value = present(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)
