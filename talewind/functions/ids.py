"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talewind.functions.text import ColumnOrName, col

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def actor_uuid(platform: ColumnOrName, platform_id: ColumnOrName) -> Column:
    return uuid5_url(F.concat(col(platform), F.lit(":"), col(platform_id).cast("string")))


def content_uuid(platform: ColumnOrName, content_id: ColumnOrName) -> Column:
    """Record id derived from the natural key, so that reading a source twice gives the same ids."""
    return uuid5_url(F.concat(F.lit("content:"), col(platform), F.lit(":"), col(content_id).cast("string")))


def trend_id(region: ColumnOrName, title: ColumnOrName, day: ColumnOrName) -> Column:
    raw = F.concat(F.lit("gtrends:"), col(region), F.lit(":"), col(title), F.lit(":"), col(day).cast("string"))
    return F.left(F.sha2(raw, 256), F.lit(24))


def anon_id(name: ColumnOrName, poster_id: ColumnOrName) -> Column:
    raw = F.concat(col(name), F.lit(":"), F.coalesce(col(poster_id), F.lit("")))
    return F.left(F.md5(raw), F.lit(16))


def row_key(*columns: ColumnOrName) -> Column:
    """Stable id of a derived row: hash of its natural key."""
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), 256), F.lit(32))
