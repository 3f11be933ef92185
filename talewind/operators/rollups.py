"""Roll-ups kept as files by day: dashboards read the days they show and never the events again.

A roll-up is a folder with ``minutes`` (keys, minute, n) and ``days`` (keys, n), both in one folder per day (the number of days since
1970). What it gives back has the shape of what went in, so the figures of ``operators/metrics.py`` are taken from it as from events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talewind.functions.times import AsOf, bucket, instant
from talewind.operators.metrics import RATE_MINUTES
from talewind.session import cut_lineage

DAY = 86400
#: Columns of the ingestion counters.
INGESTED = "platform string, family string, n long"


def write_days(events: DataFrame, path: str, keys: Sequence[str], value: str = "n", ts: str = "ts") -> None:
    """Roll up ``events`` below ``path``. Each day that they hold is replaced as a whole: give all events of a day together. So writing
    a day again changes nothing, and other days are neither read nor written. Rows without a time are in no day and are left out."""
    timed = events.filter(F.col(ts).isNotNull())
    minutes = timed.groupBy(*keys, bucket(ts, 60).alias("minute")).agg(F.sum(value).alias("n"))
    minutes = cut_lineage(minutes.withColumn("day", F.floor(F.col("minute") / DAY).cast("int")))
    days = minutes.groupBy(*keys, "day").agg(F.sum("n").alias("n"))
    for name, rows in (("minutes", minutes), ("days", days)):
        # A day goes to as many tasks as its size asks for.
        spread = rows.hint("rebalance", "day")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")


def _day(seconds: Column) -> Column:
    return F.floor(seconds / DAY).cast("int")


def minutes_between(spark: SparkSession, path: str, start: Column, end: Column, columns: str = INGESTED) -> DataFrame:
    """Sums of the minutes that begin in [start, end) (epoch seconds): keys, n, ts. Only the folders of those days are read."""
    rows = spark.read.schema(f"{columns}, minute long, day int").parquet(f"{path}/minutes")
    days = (F.col("day") >= _day(start)) & (F.col("day") <= _day(end))
    inside = rows.filter(days & (F.col("minute") >= start) & (F.col("minute") < end))
    return inside.withColumn("ts", F.timestamp_seconds("minute")).drop("minute", "day")


def totals(spark: SparkSession, path: str, columns: str = INGESTED) -> DataFrame:
    """Sums of all days: keys, n. Reads a row for each key and day."""
    rows = spark.read.schema(f"{columns}, day int").parquet(f"{path}/days")
    keys = [c for c in rows.columns if c not in ("n", "day")]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def recent(spark: SparkSession, path: str, as_of: AsOf, hours: int = 24, columns: str = INGESTED) -> DataFrame:
    """Minutes of the day and of the last ``hours`` hours, up to the running minute: what the dashboards look at."""
    now, day = bucket(instant(as_of), 60), bucket(F.date_trunc("day", instant(as_of)), 60)
    hour = bucket(instant(as_of), 3600) - (hours - 1) * 3600
    return minutes_between(spark, path, F.least(day, hour, now - (RATE_MINUTES - 1) * 60), now + 60, columns)
