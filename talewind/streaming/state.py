"""Per-key state: posting habits of authors, engagement velocity. The state of a key is bounded (last posts, last two
snapshots) and expires by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talewind.functions.times import micros
from talewind.operators.coordination import (
    DIVERSITY_CLASSES, DIVERSITY_ENTROPY, GAPS_MIN, HISTORY, HISTORY_MIN, REGULAR_CV, REGULAR_MEAN,
    TIMES_MIN,
)

HISTORY_KEPT = 200
LIFE_MS = 7 * 86_400_000

_SIGNALS = "actor_id string, content_id string, type string, confidence double, measure double, sample long"


def _judge(history_us: np.ndarray, narratives: list[str], max_cv: float, max_mean: float, max_entropy: float):
    """(type, confidence, measure, sample) for one history, newest last."""
    found = []
    gaps = np.diff(np.sort(history_us)) / 1e6
    gaps = gaps[gaps > 0]
    if len(history_us) < TIMES_MIN or len(gaps) < GAPS_MIN:
        return found
    mean = float(gaps.mean())
    cv = float(gaps.std() / mean)
    if cv < max_cv and mean < max_mean:
        found.append(("posting_regularity", float(min(1.0, max(0.0, 0.9 - cv * 2))), round(cv, 4), len(gaps)))
    counts = pd.Series([n for n in narratives if n]).value_counts().to_numpy(dtype=float)
    if len(counts) >= DIVERSITY_CLASSES:
        share = counts / counts.sum()
        entropy = float(-(share * np.log2(share)).sum() / np.log2(len(counts)))
        if entropy < max_entropy:
            found.append(("content_diversity_anomaly", round(0.7 - entropy, 3), round(entropy, 4), int(counts.sum())))
    return found


def posting_habits(
    posts: DataFrame, late: str = "10 minutes", max_cv: float = REGULAR_CV, max_mean: float = REGULAR_MEAN,
    max_entropy: float = DIVERSITY_ENTROPY,
) -> DataFrame:
    """Regularity and diversity signals, judged for every post on the author's posts before it.

    ``posts``: actor_id, content_id, created_at, narrative_id. Rows of a micro-batch are taken in event-time order.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, stories = (list(part) for part in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["us", "content_id"])
        out = []
        for us, content, story in zip(rows["us"], rows["content_id"], rows["narrative_id"]):
            if len(times) >= HISTORY_MIN:
                last = slice(-HISTORY, None)
                for signal in _judge(np.array(times[last], dtype=np.int64), stories[last], max_cv, max_mean, max_entropy):
                    out.append((key[0], content, *signal))
            times.append(int(us))
            stories.append("" if story is None else str(story))
        times, stories = times[-HISTORY_KEPT:], stories[-HISTORY_KEPT:]
        state.update((times, stories))
        state.setTimeoutTimestamp(max(max(times) // 1000, state.getCurrentWatermarkMs()) + LIFE_MS)
        yield pd.DataFrame(out, columns=["actor_id", "content_id", "type", "confidence", "measure", "sample"])

    keyed = posts.withWatermark("created_at", late).select(
        F.col("actor_id").cast("string").alias("actor_id"), F.col("content_id").cast("string").alias("content_id"), micros("created_at").alias("us"),
        F.col("narrative_id").cast("string").alias("narrative_id"), "created_at",
    )
    return keyed.groupBy("actor_id").applyInPandasWithState(
        run, _SIGNALS, "times array<bigint>, stories array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


_VELOCITY = "content_id string, us long, likes_per_hour double, replies_per_hour double, acceleration double"


def engagement_velocity(snapshots: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Growth between consecutive snapshots; the state is the last snapshot and its growth."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for us, likes, replies in pd.concat(list(batches)).sort_values(["us", "likes", "replies"])[["us", "likes", "replies"]].itertuples(index=False):
            growth = None
            if last is not None and us != last[0]:
                hours = (us - last[0]) / 3.6e9
                growth = (likes - last[1]) / hours
                acceleration = None if last[3] is None else (growth - last[3]) / hours
                out.append((key[0], int(us), growth, (replies - last[2]) / hours, acceleration))
            last = (int(us), float(likes), float(replies), growth)
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + LIFE_MS)
        yield pd.DataFrame(out, columns=["content_id", "us", "likes_per_hour", "replies_per_hour", "acceleration"])

    keyed = snapshots.withWatermark("ts", late).select(
        F.col("content_id").cast("string").alias("content_id"), micros("ts").alias("us"), F.col("likes").cast("double").alias("likes"),
        F.col("replies").cast("double").alias("replies"), "ts",
    )
    return keyed.groupBy("content_id").applyInPandasWithState(
        run, _VELOCITY, "us bigint, likes double, replies double, growth double", "append", GroupStateTimeout.EventTimeTimeout
    )
