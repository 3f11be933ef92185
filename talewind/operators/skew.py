"""Joins, windows and rankings that stay parallel when one key holds a large share of all rows.

Three shapes are covered:

* ``top_per_group``    - ranking with a bound k: reduced to k rows per key before the final shuffle.
* ``with_previous`` / ``with_last_two`` / ``running_sum`` - ordered logic over *all* rows of a key: every key is cut into time slices of
  one width, each slice is one window partition, and only one summary row per slice is carried across. The input is
  written once, whatever its size.
* ``split_hot``        - equi-joins repeated in a loop, where adaptive skew handling does not reach; ``dealt_once`` also keeps the
  large side where it lies, so that a round moves the small side only.

Every list of hot keys is small by counting: at most ``rows / rows_per_piece`` keys can exceed
``rows_per_piece`` rows, so broadcasting it is safe at any input size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talewind.session import ROWS_PER_PIECE, cut_lineage

# Spark reduces "row_number() <= k" below the shuffle only up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_MAX = 1000
SPREAD = 64
# A day in microseconds.
SLICE = 86_400_000_000


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key in ``order`` (which must be a total order), with their rank."""
    if k > GROUP_LIMIT_MAX:
        # Maps can't be hashed.
        plain = [F.col(c) for c, kind in df.dtypes if "map<" not in kind]
        spread = df.withColumn("_spread", F.pmod(F.xxhash64(*plain), F.lit(SPREAD)))
        part = Window.partitionBy(*keys, "_spread").orderBy(*order)
        df = spread.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_spread")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def _sliced(df: DataFrame, ts: str, width: int, written: bool = True) -> DataFrame:
    """``df`` written once, with ``_slice``: the number of the time slice of ``width`` that ``ts`` is in."""
    sliced = df.withColumn("_slice", F.floor(F.col(ts) / width).cast("long"))
    return cut_lineage(sliced) if written else sliced


def with_previous(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], previous: dict[str, str], width: int = SLICE
) -> DataFrame:
    """``lag(1)`` of several columns per key. ``previous`` maps new column -> source column.

    ``ts`` is a long (or other integral) column that leads ``order``; ``order`` must be total within a key. A key's rows are
    ordered within slices of ``width`` only; one row per slice is carried on to the next.
    """
    keys, order = list(keys), list(order)
    rows = _sliced(df, ts, width)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    packed = F.struct(*[F.col(src).alias(out) for out, src in previous.items()])
    lagged = rows.withColumn("_pack", packed).withColumn("_before", F.lag("_pack").over(w))
    tails = rows.groupBy(*keys, "_slice").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.select(*keys, "_slice", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"))
    out = lagged.join(carried, [*keys, "_slice"], "left")
    before = F.coalesce("_before", "_carried")
    for name in previous:
        out = out.withColumn(name, before.getField(name))
    return out.drop("_pack", "_before", "_carried", "_slice")


def with_last_two(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: Sequence[str], width: int = SLICE) -> DataFrame:
    """``columns`` of the two rows before, as structs ``_one`` (just before) and ``_two``, null where there are none. See with_previous.

    A slice hands on its last two rows; where it holds a single one, the second comes from the slice before.
    """
    keys, order = list(keys), list(order)
    rows = _sliced(df, ts, width)
    pack, w = F.struct(*columns), Window.partitionBy(*keys, "_slice").orderBy(*order)
    lagged = rows.withColumn("_one", F.lag(pack).over(w)).withColumn("_two", F.lag(pack, 2).over(w))
    tail = F.struct(pack.alias("last"), F.col("_one").alias("earlier"))
    tails = lagged.groupBy(*keys, "_slice").agg(F.max_by(tail, F.struct(*order)).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_slice")
    carried = tails.select(*keys, "_slice", F.lag("_tail").over(before).alias("_near"), F.lag("_tail", 2).over(before).alias("_far"))
    out = lagged.join(carried, [*keys, "_slice"], "left")
    first = F.col("_one").isNull()
    two = F.when(first, F.coalesce("_near.earlier", "_far.last")).otherwise(F.coalesce("_two", "_near.last"))
    return out.withColumn("_two", two).withColumn("_one", F.coalesce("_one", "_near.last")).drop("_near", "_far", "_slice")


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], sums: dict[str, str], width: int = SLICE, written: bool = True
) -> DataFrame:
    """Running totals per key up to and including the row. ``sums`` maps new column -> source column. See with_previous.

    ``written``: false where reading the input twice costs less than writing it (a few columns of stored rows).
    """
    keys, order = list(keys), list(order)
    rows = _sliced(df, ts, width, written)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(src).over(w).alias(out) for out, src in sums.items()])
    totals = rows.groupBy(*keys, "_slice").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_slice", *[F.sum(f"_t_{out}").over(earlier).alias(f"_b_{out}") for out in sums])
    joined = inside.join(base, [*keys, "_slice"], "left")
    for out in sums:
        joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col(f"_b_{out}"), F.lit(0)))
    return joined.drop("_slice", *[f"_b_{out}" for out in sums])


def split_hot(
    big: DataFrame, key: str, spread_by: str, rows_per_piece: int | None = None, known_rows: int | None = None
) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """Cut hot keys of ``big`` into pieces (column ``_piece``) and return a function that copies the rows of the
    other side of the join to every piece. Join on ``[key, "_piece"]``. ``known_rows``: row count, where the caller
    has it anyway; a frame no larger than one piece needs no look for hot keys."""
    if known_rows is not None and known_rows <= (rows_per_piece or ROWS_PER_PIECE):
        return big.withColumn("_piece", F.lit(0)), lambda other, k: other.withColumn("_piece", F.lit(0))
    rows = rows_per_piece or ROWS_PER_PIECE
    pieces = (
        big.groupBy(F.col(key).alias("_k"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > rows)
        .select("_k", F.ceil(F.col("_n") / rows).cast("int").alias("_pieces"))
    )
    small = F.broadcast(pieces)
    cut = (
        big.join(small, F.col(key) == F.col("_k"), "left")
        .withColumn("_piece", F.pmod(F.hash(spread_by), F.coalesce("_pieces", F.lit(1))))
        .drop("_k", "_pieces")
    )

    def copy(other: DataFrame, k: str) -> DataFrame:
        return (
            other.join(small, F.col(k) == F.col("_k"), "left")
            .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
            .drop("_k", "_pieces")
        )

    return cut, copy


def dealt_once(
    big: DataFrame, key: str, spread_by: str, rows_per_piece: int | None = None, known_rows: int | None = None, beside: DataFrame | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``big`` for joins on ``key`` in a loop: cut by split_hot, dealt out once and kept by the executors, in memory or on disk. Returns it and
    a function that joins it with a table that has a row per ``key``; only that table is moved, at every size. ``beside``: such a table
    that is joined before. A lost executor costs the making of its parts, so ``big`` should be a written table. Unpersist it after the loop.

    There are as many parts as cores, more only where one would exceed ``ROWS_PER_PIECE`` rows: sums by another column, made in each part
    before they are moved, then shrink alike at every size; in ever more and smaller parts they would not."""
    spark = big.sparkSession
    rows = big.count() if known_rows is None else known_rows
    cut, copy = split_hot(big, key, spread_by, rows_per_piece, rows)
    # With one piece a key the piece would be a constant, which the optimizer takes out of the join's keys.
    whole = rows <= (rows_per_piece or ROWS_PER_PIECE)
    on, parts = [key] if whole else [key, "_piece"], max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PIECE))

    def met(lying: DataFrame, other: DataFrame) -> DataFrame:
        sent = (other if whole else copy(other, key)).repartition(parts, *on)
        return lying.join(sent.hint("shuffle_hash"), on)

    # Made at once: a plan made earlier would not know how the rows lie, and joins of two dealt tables would have Spark's own number of parts.
    kept = (cut.drop("_piece") if whole else cut).repartition(parts, *on).persist()
    kept.count()
    if beside is not None:
        plain, kept = kept, met(kept, beside).persist()
        kept.count()
        plain.unpersist()
    return kept, lambda other: met(kept, other)
