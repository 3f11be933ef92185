"""Roll-ups by day give the figures of the events, and reading them touches only the days asked for."""

import pytest
from pyspark.sql import functions as F

from talewind.operators import metrics as me
from talewind.operators import rollups as ro
from talewind.plans.tables import ingested
from talewind.session import new_folder

NOON = "2024-01-15 12:00:00"
KEYS = ["platform", "family"]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_minute(events):
    return events.withColumn("ts", F.date_trunc("minute", "ts"))


@pytest.fixture(scope="module")
def store(spark, sf):
    path = new_folder(spark)
    ro.write_days(ingested(spark, sf), path, KEYS)
    return path


def test_figures_are_those_of_the_events(spark, sf, store):
    events = by_minute(ingested(spark, sf))
    near, totals = ro.recent(spark, store, NOON), ro.totals(spark, store)
    assert rows(me.source_health(near, NOON, totals)) == rows(me.source_health(events, NOON))
    assert rows(me.source_detail(near, "p3", NOON, totals)) == rows(me.source_detail(events, "p3", NOON))
    until = events.filter(F.col("ts") <= F.lit(NOON).cast("timestamp"))
    names = events.filter(F.col("family").isin(*me.FAMILIES))
    want = me.hourly_counts(until.filter(F.col("family").isin(*me.FAMILIES)), NOON, 24, ["platform"], "n", names=names)
    assert rows(me.ingestion_rate(near, NOON, totals=totals)) == rows(want)


def test_only_folders_of_the_days_are_read(spark, store):
    near = ro.recent(spark, store, NOON)
    read = {f.split("day=")[1].split("/")[0] for f in near.filter(F.col("n") > 0).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    # 19736 is 2024-01-14, where the last 24 hours begin.
    assert read <= {"19736", "19737"} and "PartitionFilters: [isnotnull(day" in plan(near)
    assert spark.read.parquet(f"{store}/minutes").select("day").distinct().count() > 20


def test_days_are_replaced_and_others_stay(spark):
    path = new_folder(spark)
    make = lambda *of: spark.createDataFrame(of, "platform string, family string, n long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    one = ("p", "posts", 2, "2024-01-01 10:00:30"), ("p", "posts", 3, "2024-01-01 10:00:59"), (None, "posts", 1, "2024-01-01 23:59:59"), ("p", "posts", 9, None)
    ro.write_days(make(*one), path, KEYS)
    ro.write_days(make(("p", "posts", 7, "2024-01-02 00:00:00")), path, KEYS)
    want = [("posts", 1, None), ("posts", 12, "p")]
    assert rows(ro.totals(spark, path)) == sorted(want, key=repr)
    # The same day again changes nothing; a corrected one replaces what it held.
    ro.write_days(make(*one), path, KEYS)
    assert rows(ro.totals(spark, path)) == sorted(want, key=repr)
    ro.write_days(make(("p", "posts", 1, "2024-01-02 05:00:00")), path, KEYS)
    assert rows(ro.totals(spark, path)) == sorted([("posts", 1, None), ("posts", 6, "p")], key=repr)
    day = lambda n: F.lit(19723 * 86400 + n).cast("long")
    assert [r.n for r in ro.minutes_between(spark, path, day(36000), day(36060)).collect()] == [5]


def test_empty(spark):
    path = new_folder(spark)
    ro.write_days(spark.createDataFrame([], "platform string, family string, n long, ts timestamp"), path, KEYS)
    assert ro.totals(spark, path).count() == 0 and ro.recent(spark, path, NOON).count() == 0
    assert me.source_health(ro.recent(spark, path, NOON), NOON, ro.totals(spark, path)).count() == 0


def test_time_bounds_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.lit("a").alias("name"), F.col("id").alias("value"), F.timestamp_seconds(F.col("id") * 3600).alias("ts")).write.parquet(f"{tmp_path}/e")
    events = spark.read.parquet(f"{tmp_path}/e")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    found = me.hourly_counts(events, "1970-01-01 05:30:00", 2, names=names)
    assert rows(found.select("name", "hour_offset", "total")) == sorted([(0, "a", 5), (-1, "a", 4), (0, "b", 0), (-1, "b", 0)], key=repr)
    for df in (found, me.rate_per_minute(events, "1970-01-01 05:00:00")):
        text = plan(df)
        assert text.count("Scan parquet") == 1 and "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
