"""Set overlap, confidence and severity expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talewind.functions.text import ColumnOrName, col

# How a biography refers to an account on another platform.
BIO_PATTERNS = {
    "twitter": (r"twitter\.com/(\w+)", r"@(\w+)", r"x\.com/(\w+)"),
    "reddit": (r"reddit\.com/u/(\w+)", r"\bu/(\w+)"),
    "youtube": (r"youtube\.com/(@?\w+)", r"youtube\.com/c/(\w+)"),
    "telegram": (r"t\.me/(\w+)",),
    "bluesky": (r"bsky\.app/profile/(\S+)",),
}


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Set overlap of two arrays; 0 when either is null or empty."""
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull() & (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def noisy_or(confidences: ColumnOrName) -> Column:
    return 1.0 - F.aggregate(col(confidences), F.lit(1.0), lambda acc, c: acc * (1.0 - c))


def noisy_or_agg(confidence: ColumnOrName) -> Column:
    return 1.0 - F.product(1.0 - col(confidence))


def normalized_entropy(counts: ColumnOrName) -> Column:
    """Shannon entropy of the counts divided by its maximum; 0 for fewer than two classes."""
    arr = col(counts)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, c: acc + c)
    bits = F.aggregate(arr, F.lit(0.0), lambda acc, c: F.when(c > 0, acc - c / total * F.log2(c / total)).otherwise(acc))
    return F.when(F.size(arr) > 1, bits / F.log2(F.size(arr))).otherwise(0.0)


def capped_ratio(x: ColumnOrName, cap: float) -> Column:
    return F.least(F.coalesce(col(x), F.lit(0)) / F.lit(cap), F.lit(1.0))


def severity_of(confidence: ColumnOrName) -> Column:
    c = col(confidence)
    return F.when(c > 0.9, "critical").when(c > 0.75, "high").otherwise("medium")


def account_name(c: ColumnOrName) -> Column:
    return F.btrim(F.lower(col(c)), F.lit("@"))


def username_score(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = account_name(a), account_name(b)
    usable = (F.coalesce(col(a), F.lit("")) != "") & (F.coalesce(col(b), F.lit("")) != "")
    bare_x, bare_y = F.regexp_replace(x, r"[_\-.]", ""), F.regexp_replace(y, r"[_\-.]", "")
    return (
        F.when(~usable, 0.0)
        .when(x == y, 0.60)
        .when(bare_x == bare_y, 0.45)
        .when(F.levenshtein(x, y, 2) >= 0, 0.35)
        .otherwise(0.0)
    )


def bio_handles(bio: ColumnOrName, platform: str) -> Column:
    """First account name each pattern of ``platform`` finds in the text."""
    found = [F.regexp_extract(F.coalesce(col(bio), F.lit("")), f"(?iU){p}", 1) for p in BIO_PATTERNS[platform]]
    return F.array(*[account_name(h) for h in found])


def bio_score(bio: ColumnOrName, platform: ColumnOrName, username: ColumnOrName) -> Column:
    name = account_name(username)
    hits = [(col(platform) == p) & F.array_contains(bio_handles(bio, p), name) for p in BIO_PATTERNS]
    usable = F.coalesce(name, F.lit("")) != ""
    return F.when(usable & F.coalesce(reduce(Column.__or__, hits), F.lit(False)), 0.90).otherwise(0.0)


def behavior_score(hours_a: ColumnOrName, hours_b: ColumnOrName, topics_a: ColumnOrName, topics_b: ColumnOrName) -> Column:
    """Overlap of active hours (.4) and topics (.6), renormalised over what both sides have, at most .4."""

    def have(a: ColumnOrName, b: ColumnOrName) -> Column:
        return (F.coalesce(F.size(col(a)), F.lit(0)) > 0) & (F.coalesce(F.size(col(b)), F.lit(0)) > 0)

    hour_weight = F.when(have(hours_a, hours_b), 0.4).otherwise(0.0)
    topic_weight = F.when(have(topics_a, topics_b), 0.6).otherwise(0.0)
    weight = hour_weight + topic_weight
    score = hour_weight * jaccard(hours_a, hours_b) + topic_weight * jaccard(topics_a, topics_b)
    return F.when(weight > 0, score / weight * 0.4).otherwise(0.0)


def fingerprint_score(shared: ColumnOrName) -> Column:
    n = F.coalesce(col(shared), F.lit(0))
    return F.when(n > 0, F.least(F.lit(0.80), 0.40 + n * 0.10)).otherwise(0.0)


def origin_score(a: ColumnOrName, b: ColumnOrName) -> Column:
    x, y = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    return F.when((x != "") & (x == y), 1.0).otherwise(0.0)


def reaction_total(reactions: ColumnOrName) -> Column:
    values = F.coalesce(F.map_values(col(reactions)), F.array().cast("array<bigint>"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, n: acc + F.coalesce(n, F.lit(0)).cast("long"))
