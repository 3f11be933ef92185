"""Time expressions. Missing or unreadable times fall back to ``as_of``, never to the wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from talewind.functions.text import ColumnOrName, col

AsOf = Column | dt.datetime | str


def instant(as_of: AsOf) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def parse_iso_ts(c: ColumnOrName, as_of: AsOf) -> Column:
    return F.coalesce(F.try_to_timestamp(col(c)), instant(as_of))


def parse_epoch_ts(c: ColumnOrName, as_of: AsOf | None = None) -> Column:
    """Epoch seconds; 0 or null means unknown where ``as_of`` is given, else the epoch itself."""
    seconds = col(c).cast("double")
    if as_of is None:
        return F.timestamp_micros((F.coalesce(seconds, F.lit(0.0)) * 1_000_000).cast("long"))
    parsed = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    return F.when(seconds.isNull() | (seconds == 0), instant(as_of)).otherwise(parsed)


def parse_entry_ts(published: ColumnOrName, updated: ColumnOrName, as_of: AsOf) -> Column:
    return F.coalesce(F.try_to_timestamp(col(published)), F.try_to_timestamp(col(updated)), instant(as_of))


def micros(c: ColumnOrName) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return (micros(later) - micros(earlier)) / 1_000_000


def bucket(c: ColumnOrName, seconds: int) -> Column:
    """Start of the fixed bucket the time falls in, as epoch seconds."""
    return (F.floor(micros(c) / (seconds * 1_000_000)) * seconds).cast("long")


def since(ts: ColumnOrName, as_of: AsOf, **interval: int) -> Column:
    """``ts`` lies after ``as_of`` minus the interval."""
    span = dt.timedelta(**interval)
    return col(ts).cast("timestamp") > instant(as_of) - F.make_dt_interval(secs=F.lit(span.total_seconds()))
