"""Similar past narratives and what they suggest.

Narrative state: narrative_id, status, keywords, category, velocity_curve array<double>, platforms, origin_platform,
coordination_score, duration_hours, peak_velocity, summary, outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talewind.functions.curves import resample_curve, standardize_curve, standardized_similarity
from talewind.functions.ids import row_key
from talewind.functions.scores import jaccard, origin_score
from talewind.functions.times import AsOf, instant
from talewind.operators.skew import top_per_group
from talewind.schemas import ACTIVE_STATES, HISTORICAL_STATES

# Weights of the similarity dimensions, thresholds of the forecasts.
WEIGHTS = {"semantic": 0.30, "velocity": 0.25, "platform": 0.20, "network": 0.15, "origin": 0.10}
MATCH_SCORE, MATCHES_KEPT, MIN_HISTORY = 0.50, 5, 20
PEAK_SHARE, MIGRATION_SHARE, COORDINATED = 0.4, 0.3, 0.5


def active_narratives(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin(*ACTIVE_STATES))


def historical_narratives(state: DataFrame, minimum: int = MIN_HISTORY) -> DataFrame:
    """Finished or fading narratives; none at all where there are too few to compare with."""
    past = state.filter(F.col("status").isin(*HISTORICAL_STATES))
    enough = past.limit(minimum).count() >= minimum
    return past if enough else past.limit(0)


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _side(state: DataFrame, prefix: str) -> DataFrame:
    """Columns of one side, its curve standardised once, exploded to the keys a match must share."""
    no_strings = F.array().cast("array<string>")
    keys = F.array_distinct(
        F.concat(
            F.transform(F.coalesce("keywords", no_strings), lambda k: F.concat(F.lit("k:"), k)),
            F.transform(F.coalesce("platforms", no_strings), lambda p: F.concat(F.lit("p:"), p)),
            F.array(F.concat(F.lit("c:"), F.coalesce("category", F.lit("")))),
        )
    )
    columns = ["narrative_id", "keywords", "platforms", "category", "origin_platform", "coordination_score"]
    side = state.select(
        *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
        standardize_curve(resample_curve("velocity_curve")).alias(f"{prefix}_curve"),
        keys.alias(f"{prefix}_keys"),
    )
    return side.withColumn("_key", F.explode(f"{prefix}_keys"))


def narrative_similarity(current: DataFrame, history: DataFrame, above: float = MATCH_SCORE) -> DataFrame:
    """Pairs with a score above the threshold and their five dimensions.

    Keywords, platforms and category can be shared or not; without any of them a pair reaches at most
    velocity + network + origin = 0.50. So every pair above that shares a key, and the comparison is an equi-join on
    keys instead of all pairs. A pair is scored at its smallest shared key only, and its curve only where the cheap
    dimensions leave room to pass.
    """
    if above < WEIGHTS["velocity"] + WEIGHTS["network"] + WEIGHTS["origin"] - 1e-12:
        raise ValueError("below this score a pair need not share any key")
    pairs = _side(current, "c").join(_side(history, "h"), "_key").filter(F.col("c_narrative_id") != F.col("h_narrative_id"))
    pairs = pairs.filter(F.col("_key") == F.array_min(F.array_intersect("c_keys", "h_keys")))
    same_category = F.col("c_category").eqNullSafe(F.col("h_category"))
    semantic = (
        F.when((_size("c_keywords") > 0) & (_size("h_keywords") > 0), jaccard("c_keywords", "h_keywords"))
        .when(same_category, 0.5).otherwise(0.0)
    )
    gap = F.abs(F.coalesce("c_coordination_score", F.lit(0.0)) - F.coalesce("h_coordination_score", F.lit(0.0)))
    rated = pairs.select(
        "c_narrative_id", "h_narrative_id", "c_curve", "h_curve",
        semantic.alias("semantic"), jaccard("c_platforms", "h_platforms").alias("platform"), (1.0 - gap).alias("network"),
        origin_score("c_origin_platform", "h_origin_platform").alias("origin"),
    )
    cheap = sum((F.lit(WEIGHTS[d]) * F.col(d) for d in ("semantic", "platform", "network", "origin")), F.lit(0.0))
    near = rated.withColumn("_cheap", cheap).filter(F.col("_cheap") + WEIGHTS["velocity"] > above)
    full = near.withColumn("velocity", standardized_similarity("c_curve", "h_curve"))
    scored = full.withColumn("score", F.col("_cheap") + WEIGHTS["velocity"] * F.col("velocity"))
    return scored.filter(F.col("score") > above).select(
        F.col("c_narrative_id").alias("narrative_id"), F.col("h_narrative_id").alias("matched_narrative_id"), "score",
        "semantic", "velocity", "platform", "network", "origin",
    )


def pattern_matches(similar: DataFrame, history: DataFrame, k: int = MATCHES_KEPT) -> DataFrame:
    """The best matches per narrative with the past narrative's life: rank, similarity_score, lifecycle, dimensions."""
    best = top_per_group(similar, ["narrative_id"], [F.desc("score"), F.asc("matched_narrative_id")], k)
    past = history.select(
        F.col("narrative_id").alias("matched_narrative_id"),
        F.coalesce("summary", F.lit("")).alias("matched_summary"), F.coalesce("outcome", F.lit("")).alias("outcome_summary"),
        F.struct(
            F.coalesce("duration_hours", F.lit(0.0)).alias("total_duration_hours"),
            F.coalesce("peak_velocity", F.lit(0.0)).alias("peak_velocity"),
            F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms_reached"),
            (F.coalesce("coordination_score", F.lit(0.0)) > COORDINATED).alias("coordination_detected"),
            F.col("status").alias("final_status"),
        ).alias("lifecycle"),
    )
    joined = best.join(past, "matched_narrative_id")
    return joined.select(
        "narrative_id", "rank", "matched_narrative_id", F.round("score", 4).alias("similarity_score"), "matched_summary",
        "outcome_summary", "lifecycle", F.struct(*[F.round(d, 3).alias(d) for d in WEIGHTS]).alias("similarity_dimensions"),
    )


def _match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("narrative_id").agg(F.count("*").alias("matches"))


def predict_peak(matches: DataFrame) -> DataFrame:
    """Hours to the peak: mean and population deviation over the matches."""
    hours = F.col("lifecycle.total_duration_hours")
    peak = F.when(hours > 0, hours * PEAK_SHARE)
    grouped = matches.groupBy("narrative_id").agg(
        F.count("*").alias("matches"), F.avg(peak).alias("predicted_timeframe_hours"), F.stddev_pop(peak).alias("deviation_hours")
    ).filter(F.col("predicted_timeframe_hours").isNotNull())
    return grouped.select(
        "narrative_id", F.lit("peak_timing").alias("prediction_type"), "matches", "predicted_timeframe_hours", "deviation_hours",
        F.round(F.least(F.lit(0.85), 0.4 + F.col("matches") * 0.1), 3).alias("confidence"),
    )


def predict_migration(matches: DataFrame, state: DataFrame) -> DataFrame:
    """The platform most matches reached and the narrative has not."""
    reached = matches.select("narrative_id", F.explode("lifecycle.platforms_reached").alias("platform"))
    here = state.select("narrative_id", F.explode("platforms").alias("platform"))
    counts = reached.join(here, ["narrative_id", "platform"], "left_anti").groupBy("narrative_id", "platform").agg(
        F.count("*").alias("n")
    )
    top = top_per_group(counts, ["narrative_id"], [F.desc("n"), F.asc("platform")], 1).drop("rank")
    rated = top.join(_match_counts(matches), "narrative_id").withColumn("probability", F.col("n") / F.col("matches"))
    return rated.filter(F.col("probability") >= MIGRATION_SHARE).select(
        "narrative_id", F.lit("platform_migration").alias("prediction_type"), "matches", F.col("platform").alias("target_platform"),
        "probability", F.round(F.least(F.lit(0.85), F.col("probability")), 3).alias("confidence"),
    )


def predict_coordination(matches: DataFrame, state: DataFrame) -> DataFrame:
    """Risk of coordinated amplification: share of coordinated matches and the present score."""
    coordinated = F.avg(F.when(F.col("lifecycle.coordination_detected"), 1.0).otherwise(0.0))
    grouped = matches.groupBy("narrative_id").agg(F.count("*").alias("matches"), coordinated.alias("_share"))
    joined = grouped.join(state.select("narrative_id", "coordination_score"), "narrative_id", "left")
    return joined.select(
        "narrative_id", F.lit("coordination_risk").alias("prediction_type"), "matches",
        (F.col("_share") * 0.6 + F.coalesce("coordination_score", F.lit(0.0)) * 0.4).alias("probability"),
        F.round(F.least(F.lit(0.90), 0.3 + F.col("matches") * 0.05), 3).alias("confidence"),
    )


def predictions(matches: DataFrame, state: DataFrame, as_of: AsOf | None = None) -> DataFrame:
    """All forecasts with the three best matches as their basis."""
    peak = predict_peak(matches)
    migration = predict_migration(matches, state)
    risk = predict_coordination(matches, state)
    every = peak.unionByName(migration, allowMissingColumns=True).unionByName(risk, allowMissingColumns=True)
    basis = matches.filter(F.col("rank") <= 3).groupBy("narrative_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "matched_narrative_id"))), lambda m: m["matched_narrative_id"]).alias("basis")
    )
    out = every.join(basis, "narrative_id")
    if as_of is not None:
        out = out.withColumn("predicted_at", instant(as_of)).withColumn("id", row_key("narrative_id", "prediction_type"))
    return out
