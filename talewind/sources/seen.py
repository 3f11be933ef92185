"""First sightings with a life time, and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.operators.skew import split_hot
from talewind.session import ROWS_PER_PIECE, cut_lineage, fits_one_task

# Hours a source key stays "seen".
SEEN_HOURS = {
    "reddit": 48, "rss": 48, "twitter": 48, "youtube": 48, "bluesky": 48, "telegram": 48, "4chan": 24, "wikipedia": 24,
    "substack": 72, "web": 4,
}


def emission_times(times: DataFrame, key: str, ts_us: str, ttl_us: int, rows_per_piece: int | None = None) -> DataFrame:
    """Per key the times that count as a new sighting: the first, then each first one more than ``ttl`` after the
    last counted. ``times``: key, ts_us (long). Result: key, ts_us.

    Ordinary keys fold their sorted distinct times in one expression. A key with more rows than a task should hold is
    advanced by rounds instead: each round finds the next counted time by a partially aggregated minimum, so no task
    holds the key; the number of rounds is the time span divided by the life time.
    """
    if rows_per_piece is None and fits_one_task(times):
        return _folded(times, key, ts_us, ttl_us)
    rows = rows_per_piece or ROWS_PER_PIECE
    counts = times.groupBy(key).agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.filter(F.col("_n") > rows).select(key))  # at most all rows / rows of them
    ordinary = _folded(times.join(hot, key, "left_anti"), key, ts_us, ttl_us)
    return ordinary.unionByName(_by_rounds(times.join(hot, key, "left_semi"), key, ts_us, ttl_us, rows))


def _folded(times: DataFrame, key: str, ts_us: str, ttl_us: int) -> DataFrame:
    start = F.expr("CAST(array() AS array<bigint>)")

    def step(kept, t):
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (t - last > ttl_us), F.concat(kept, F.array(t))).otherwise(kept)

    def safe_step(kept, t):
        return F.when(F.size(kept) == 0, F.array(t)).otherwise(step(kept, t))

    ordered = times.groupBy(key).agg(F.array_sort(F.collect_set(ts_us)).alias("_t"))
    return ordered.select(key, F.explode(F.aggregate("_t", start, safe_step)).alias(ts_us))


def _by_rounds(times: DataFrame, key: str, ts_us: str, ttl_us: int, rows: int) -> DataFrame:
    pieces, copy = split_hot(times.select(key, ts_us), key, ts_us, rows)
    front = cut_lineage(times.groupBy(key).agg(F.min(ts_us).alias(ts_us)))
    found = front
    while not front.isEmpty():
        last = copy(front.withColumnRenamed(ts_us, "_last"), key)
        later = pieces.join(last, [key, "_piece"]).filter(F.col(ts_us) > F.col("_last") + ttl_us)
        front = cut_lineage(later.groupBy(key).agg(F.min(ts_us).alias(ts_us)))
        found = found.unionByName(front)
    return found


def drop_seen(
    df: DataFrame, key: str, ts_us: str, tie: str, ttl_hours: float, rows_per_piece: int | None = None
) -> DataFrame:
    """Rows that count as a first sighting of their key; of equal times the one with the smallest ``tie``."""
    kept = emission_times(df.select(key, ts_us), key, ts_us, int(ttl_hours * 3_600_000_000), rows_per_piece)
    first = df.groupBy(key, ts_us).agg(F.min(tie).alias(tie))
    return df.join(first.join(kept, [key, ts_us]), [key, ts_us, tie], "left_semi")


def read_increment(df: DataFrame, state: DataFrame, channel: str, number: str) -> DataFrame:
    """Rows above the high mark of their channel. ``state``: channel, high_mark; unknown channels start at 0."""
    marked = df.join(state.select(channel, "high_mark"), channel, "left")
    return marked.filter(F.col(number) > F.coalesce("high_mark", F.lit(0))).drop("high_mark")


def advance_marks(state: DataFrame, fresh: DataFrame, channel: str, number: str) -> DataFrame:
    """High marks after reading ``fresh``."""
    both = state.select(channel, "high_mark").unionByName(fresh.select(channel, F.col(number).alias("high_mark")))
    return both.groupBy(channel).agg(F.max("high_mark").alias("high_mark"))
