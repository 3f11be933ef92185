"""Language profiles of communities and their drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.functions.ids import row_key
from talewind.functions.text import ngrams, words
from talewind.functions.times import AsOf, instant, since
from talewind.operators.skew import top_per_group
from talewind.session import spread_small

DRIFT_MEDIUM, DRIFT_HIGH = 0.15, 0.25
MIN_TEXTS = 50
NEW_NGRAMS_SHOWN = 20


def _lowered_words(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return spread_small(df.select(*keep, text)).select(*keep, words(F.lower(text)).alias("_words"))


def top_ngrams(df: DataFrame, group: Sequence[str], text: str = "text", n: int = 2, k: int = 100) -> DataFrame:
    """``k`` most frequent n-grams per group with their count; ties alphabetical."""
    grams = _lowered_words(df, text, group).select(*group, F.explode(ngrams(F.col("_words"), n)).alias("ngram"))
    counted = grams.groupBy(*group, "ngram").agg(F.count("*").alias("n"))
    return top_per_group(counted, list(group), [F.desc("n"), F.asc("ngram")], k)


def type_token_ratio(df: DataFrame, group: Sequence[str], text: str = "text") -> DataFrame:
    """Distinct words over words per group; groups without words get 0.

    Words are counted per (group, word) first, so a large group is spread over its vocabulary.
    """
    each = _lowered_words(df, text, group).select(*group, F.explode_outer("_words").alias("_word"))
    types = each.groupBy(*group, "_word").agg(F.count("_word").alias("_n"))
    return types.groupBy(*group).agg(
        F.coalesce(F.count("_word") / F.nullif(F.sum("_n"), F.lit(0)), F.lit(0.0)).alias("type_token_ratio")
    )


def community_texts(
    posts: DataFrame, members: DataFrame, as_of: AsOf | None = None, hours: int = 24, per_actor: int = 50,
    actors: int | None = None, cap: int | None = None,
) -> DataFrame:
    """Latest texts of a community's members. ``posts``: actor_id, content_id, created_at, text; ``members``:
    community_id, actor_id. ``per_actor`` is the length of an account's recent-text list; ``actors`` and ``cap``
    bound members and texts per community where wanted (default: all)."""
    if actors is not None:
        members = top_per_group(members, ["community_id"], [F.asc("actor_id")], actors).drop("rank")
    usable = posts.filter(F.coalesce("text", F.lit("")) != "")
    if as_of is not None:
        usable = usable.filter(since("created_at", as_of, hours=hours) & (F.col("created_at") <= instant(as_of)))
    recent = top_per_group(usable, ["actor_id"], [F.desc("created_at"), F.desc("content_id")], per_actor).drop("rank")
    texts = recent.join(members, "actor_id")
    if cap is not None:
        texts = top_per_group(texts, ["community_id"], [F.desc("created_at"), F.desc("content_id")], cap).drop("rank")
    return texts.select("community_id", "actor_id", "content_id", "created_at", "text")


def language_profile(df: DataFrame, group: str, text: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """Texts, mean words per text and vocabulary richness of groups with enough texts. Their n-grams: ``top_ngrams``."""
    sizes = df.groupBy(group).agg(
        F.count("*").alias("texts"), F.avg(F.size(words(text))).alias("avg_text_length")
    ).filter(F.col("texts") >= min_texts)
    return sizes.join(type_token_ratio(df, [group], text), group)


def ngram_drift(current: DataFrame, baseline: DataFrame, group: str) -> DataFrame:
    """Jaccard distance of the n-gram sets per group (1 where one side has none), and the first new n-grams in alphabetical order."""
    now = current.select(group, "ngram", F.lit(1).alias("_now"))
    then = baseline.select(group, "ngram", F.lit(1).alias("_then"))
    both = now.join(then, [group, "ngram"], "full_outer")
    fresh = F.when(F.col("_then").isNull(), F.col("ngram"))
    return both.groupBy(group).agg(
        (1 - F.count(F.when(F.col("_now").isNotNull() & F.col("_then").isNotNull(), 1)) / F.count("*")).alias("ngram_drift"),
        # Bounded by the n-grams kept per profile.
        F.slice(F.array_sort(F.collect_list(fresh)), 1, NEW_NGRAMS_SHOWN).alias("new_ngrams"),
    )


def language_shift(
    current: DataFrame, baseline: DataFrame, current_ngrams: DataFrame, baseline_ngrams: DataFrame, group: str,
    as_of: AsOf | None = None,
) -> DataFrame:
    """Alerts for groups whose n-grams drifted. Profiles as from ``language_profile``, n-grams from ``top_ngrams``.
    Groups without a baseline give no alert (see ``updated_baseline``)."""
    drift = ngram_drift(current_ngrams, baseline_ngrams, group).filter(F.col("ngram_drift") > DRIFT_MEDIUM)
    old = baseline.select(group, F.col("type_token_ratio").alias("_ttr"), F.col("avg_text_length").alias("_len"))
    joined = current.join(old, group).join(drift, group)
    out = joined.select(
        group,
        F.lit("language_shift").alias("type"),
        F.when(F.col("ngram_drift") > DRIFT_HIGH, "high").otherwise("medium").alias("severity"),
        F.round("ngram_drift", 4).alias("ngram_drift"),
        "new_ngrams",
        F.round(F.col("type_token_ratio") - F.col("_ttr"), 4).alias("vocab_richness_change"),
        F.round(F.col("avg_text_length") - F.col("_len"), 1).alias("avg_length_change"),
    )
    if as_of is not None:
        out = out.withColumn("detected_at", instant(as_of)).withColumn("id", row_key("type", group, "detected_at"))
    return out


def updated_baseline(current: DataFrame, baseline: DataFrame, group: str) -> DataFrame:
    """Baseline after a run: kept where one exists, else the current profile."""
    return baseline.unionByName(current.join(baseline.select(group), group, "left_anti"))
