"""Text expressions: cleaning, references, words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# HTML entities of comment bodies, decoded in this order.
COMMENT_ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'"))
# Title prefixes of encyclopedia pages worth watching.
WATCHED_PREFIXES = (
    "2024", "2025", "2026", "Russo-Ukrainian War", "Russia", "Ukraine", "Israel", "Palestine", "Gaza", "COVID-19",
    "SARS-CoV-2", "Artificial intelligence", "Large language model", "Climate change", "Global warming", "Election",
    "Referendum", "Disinformation", "Misinformation", "NATO", "European Union", "United States", "China", "Taiwan",
    "Assassination", "Mass shooting", "Cryptocurrency", "Bitcoin",
)
# News domains whose articles are not fetched.
PAYWALLED_DOMAINS = ("nytimes.com", "washingtonpost.com", "bloomberg.com", "wsj.com", "ft.com", "economist.com")
# Counter family of a content type; every other type counts as posts.
METRIC_FAMILIES = {"comment": "comments", "reply": "comments", "article": "articles"}


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: ColumnOrName) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def words(c: ColumnOrName) -> Column:
    """White-space separated words, empty strings dropped; null text has no words."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), "")


def ngrams(word_array: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by a blank."""
    grams = word_array
    for shift in range(1, n):
        following = F.slice(word_array, F.lit(shift + 1), F.greatest(F.size(word_array), F.lit(1)))
        grams = F.zip_with(grams, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull())


def clean_comment_html(c: ColumnOrName) -> Column:
    """Line breaks to newlines, other tags dropped, five entities decoded, trimmed; null becomes empty."""
    text = F.coalesce(col(c), F.lit(""))
    for tag in ("<br>", "<br/>"):
        text = F.replace(text, F.lit(tag), F.lit("\n"))
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, plain in COMMENT_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return strip(text)


def backlinks(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(?U)>>(\d+)"), F.lit(1))


def user_mentions(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?iU)(?:^|[\s(])/?(u/\w+)"), F.lit(1))


def cashtags(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)\$([A-Z]{1,5})\b"), F.lit(1))


def present(values: Column) -> Column:
    """Array without nulls and empty strings; a null array becomes empty."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_high_signal(title: ColumnOrName) -> Column:
    lowered = F.lower(col(title))
    return reduce(Column.__or__, [lowered.startswith(p.lower()) for p in WATCHED_PREFIXES])


def is_paywalled(url: ColumnOrName) -> Column:
    host = F.coalesce(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), F.lit(""))
    return reduce(Column.__or__, [host.contains(d) for d in PAYWALLED_DOMAINS])


def revert_flag(comment: ColumnOrName) -> Column:
    lowered = F.lower(F.coalesce(col(comment), F.lit("")))
    return lowered.contains("revert") | lowered.contains("undo")


def diff_size(new_length: ColumnOrName, old_length: ColumnOrName) -> Column:
    return F.coalesce(col(new_length), F.lit(0)) - F.coalesce(col(old_length), F.lit(0))


def embedding_text(title: ColumnOrName, text: ColumnOrName, max_words: int | None = None) -> Column:
    """Title and body, single blanks between the words. ``max_words``: the input window of an encoder that has one."""
    every = words(F.concat_ws(" ", col(title), col(text)))
    return F.array_join(every if max_words is None else F.slice(every, 1, max_words), " ")


def preview(c: ColumnOrName, length: int = 200) -> Column:
    return F.left(col(c), F.lit(length))


def excerpt(c: ColumnOrName, length: int = 300) -> Column:
    return F.when(F.length(col(c)) > length, F.concat(F.left(col(c), F.lit(length)), F.lit("..."))).otherwise(col(c))


def metric_family(content_type: ColumnOrName) -> Column:
    family = F.create_map(*[F.lit(x) for pair in METRIC_FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(family, col(content_type)), F.lit("posts"))


def parse_traffic(c: ColumnOrName) -> Column:
    """``200K+``, ``1,000``, ``2M`` to a whole number; anything unreadable is 0."""
    plain = F.upper(strip(F.regexp_replace(col(c), r"[+,]", "")))
    factor = F.when(plain.endswith("K"), 1_000).when(plain.endswith("M"), 1_000_000).otherwise(1)
    number = F.regexp_replace(plain, r"[KM]$", "").try_cast("double")
    # try_cast also reads words such as NaN; only finite numbers count.
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e12)
    return F.when(usable, F.floor(F.abs(number) * factor) * F.signum(number)).otherwise(0).cast("long")
