"""Session helpers: the checkpoint folder and plan-time size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# An input estimated below this many bytes can be handled by one task, so no key in it can be "hot".
ONE_TASK_BYTES = 256 * 1024 * 1024
# Rows one task should hold of a single key before the key is cut into pieces.
ROWS_PER_PIECE = 4_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent *and* the master is local, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talewind-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def new_folder(spark: SparkSession) -> str:
    """A name for a table below the shared checkpoint folder that no other has."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/talewind/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it back.

    A lost executor then costs no replay of the loop. Unlike a checkpointed frame, a table also carries its true size:
    joins in later rounds are planned from it, and estimates do not multiply from round to round.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (file size at the leaves, so cheap: nothing runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_one_task(df: DataFrame) -> bool:
    return estimated_bytes(df) <= ONE_TASK_BYTES


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that may be a single file split over all cores before heavy work per row. Larger inputs have
    splits enough and are left as they are, without a shuffle."""
    if df.isStreaming or not fits_one_task(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
