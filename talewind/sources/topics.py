"""Topic reads and writes, batch and streaming, on Kafka or on JSON files (one folder per topic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def read_topic(
    spark: SparkSession, topics: Sequence[str], schema: T.StructType, fmt: str = "kafka", stream: bool = False,
    servers: str = "", root: str = "", rows_per_trigger: int | None = None, **options: str,
) -> DataFrame:
    """Rows ``topic``, ``value`` (raw JSON) and ``record`` (parsed, null where unreadable), from the earliest offset."""
    reader = spark.readStream if stream else spark.read
    if fmt == "kafka":
        reader = (
            reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
            .option("startingOffsets", "earliest")
        )
        if stream and rows_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", rows_per_trigger)
        raw = reader.options(**options).load().select("topic", F.col("value").cast("string").alias("value"))
    else:
        frames = []
        for topic in topics:
            one = reader.format("text").options(**options).schema("value string").load(f"{root}/{topic}")
            frames.append(one.select(F.lit(topic).alias("topic"), "value"))
        raw = frames[0]
        for other in frames[1:]:
            raw = raw.unionByName(other)
    return raw.withColumn("record", F.from_json("value", schema))


def keyed_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_topic(df: DataFrame, topic: str, key: str, fmt: str = "kafka", servers: str = "", root: str = "") -> None:
    """Append the rows of a batch as keyed JSON."""
    rows = keyed_json(df, key)
    if fmt == "kafka":
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        rows.select("value").write.mode("append").text(f"{root}/{topic}")


def write_topic_stream(
    df: DataFrame, topic: str, key: str, checkpoint: str, fmt: str = "kafka", servers: str = "", root: str = ""
) -> DataStreamWriter:
    """Writer of a stream as keyed JSON; the caller sets the trigger and starts it."""
    rows = keyed_json(df, key)
    if fmt == "kafka":
        writer = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    else:
        writer = rows.select("value").writeStream.format("text").option("path", f"{root}/{topic}")
    return writer.option("checkpointLocation", checkpoint)
