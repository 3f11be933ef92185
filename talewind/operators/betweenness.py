"""Betweenness centrality, exact or from sampled sources.

The work is sources times links. Links that a task can hold (``LINKS_HELD``) are copied to some tasks, which walk them from
their own sources and give back one sum a node, so that no row (source, node) is ever made. More links are never together in a
task: levels are then tables, and links go in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.operators.skew import split_hot
from talewind.session import cut_lineage

# Rows (source, node) of a batch, at most, unless so few sources have more; sources and links of one task.
STATE_ROWS, BATCHES_OF = 20_000_000, 500
SOURCES_PER_TASK, LINKS_PER_TASK = 128, 1_000_000
# Cells (source, node) of such a task's matrices.
CELLS_PER_TASK = 4_000_000
_LINKS_AT_ONCE = 1 << 14
# Links that a task may hold (8 bytes each, some 24 while they are put in order); steps over links worth a task; tasks for a core, at most.
LINKS_HELD, STEPS_PER_TASK, TASKS_PER_CORE = 16_000_000, 20_000_000, 4
# Cells (source, node) walked at a time, small enough for a processor's cache, and links looked at in one go.
_CELLS, _STEPS = 1 << 19, 1 << 17


def sampled_sources(nodes: DataFrame, sample: int | None, seed: int = 0) -> DataFrame:
    """``sample`` nodes by seeded hash; all of them where there are fewer, or without a sample."""
    if sample is None:
        return nodes
    return nodes.orderBy(F.xxhash64("actor_id", F.lit(seed)), "actor_id").limit(sample)


def betweenness(
    edges: DataFrame, sample: int | None = None, seed: int = 0, directed: bool = True, sources_per_batch: int | None = None,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """actor_id, betweenness: shortest paths that lead through the actor (raw sums), from all
    sources or from ``sample`` of them, then scaled by nodes / sample to mean the same.

    Level-synchronous Brandes. Where a task can hold the links, it does all levels of its sources, some at a time. Else the
    state is a table (source, node, paths) for each depth; a level forward brings a block of links and the rows of its nodes
    for some sources into one task, which adds them up as matrices, so that links are never multiplied by sources as rows; a
    level backward does the same. Sources are handled in batches, which bounds the state.
    """
    pairs = edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    if not directed:
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = cut_lineage(pairs.distinct())
    ends = pairs.select(F.col("src").alias("actor_id")).unionByName(pairs.select(F.col("dst").alias("actor_id"))).distinct()
    nodes = _numbered(ends)
    number = lambda end: nodes.select(F.col("actor_id").alias(end), F.col("node").alias(f"_{end}"))
    links = cut_lineage(pairs.join(number("src"), "src").join(number("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    rows, total = links.count(), nodes.count()
    used = total if sample is None else min(sample, total)
    scale = total / max(1, used)
    if rows <= LINKS_HELD and sources_per_batch is None:
        sums = _walked(links, sampled_sources(nodes, sample, seed), total, used * rows)
        return nodes.join(sums, "node", "left").select("actor_id", (F.coalesce("betweenness", F.lit(0.0)) * scale).alias("betweenness"))
    forward, backward = (_blocks(links, rows, *ends, rows_per_piece) for ends in (("src", "dst"), ("dst", "src")))
    batches = max(1, -(-used // (sources_per_batch or max(BATCHES_OF, STATE_ROWS // max(1, total)))))
    chosen = cut_lineage(
        sampled_sources(nodes, sample, seed).withColumn("batch", F.pmod(F.xxhash64("actor_id", F.lit(seed + 1)), F.lit(batches)))
    )
    together = max(1, min(SOURCES_PER_TASK, CELLS_PER_TASK // max(1, total)))
    groups = max(1, -(-used // (batches * together)))
    sums = None
    for batch in range(batches):
        starts = chosen.filter(F.col("batch") == batch).select(
            F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")
        )
        part = _dependencies(starts, forward, backward, groups)
        sums = part if sums is None else cut_lineage(
            sums.unionByName(part).groupBy("node").agg(F.sum("betweenness").alias("betweenness"))
        )
    scored = nodes.join(sums, "node", "left")
    return scored.select("actor_id", (F.coalesce("betweenness", F.lit(0.0)) * scale).alias("betweenness"))


def _numbered(ends: DataFrame) -> DataFrame:
    """actor_id, node: numbers from 0 on without gaps."""
    # Numbers within partitions, moved by the rows of the partitions before: one row per partition.
    raw = cut_lineage(ends.withColumn("_n", F.monotonically_increasing_id()))
    sizes = {r["_p"]: r["count"] for r in raw.groupBy(F.shiftright("_n", 33).alias("_p")).count().collect()}
    first, before = 0, {}
    for p in sorted(sizes):
        first, before[p] = first + sizes[p], first
    moved = raw.sparkSession.createDataFrame(list(before.items()), "_p long, _first long")
    within = F.col("_n") - F.shiftleft("_p", 33)
    placed = raw.withColumn("_p", F.shiftright("_n", 33)).join(F.broadcast(moved), "_p")
    return cut_lineage(placed.select("actor_id", (F.col("_first") + within).alias("node")))


def _walked(links: DataFrame, sources: DataFrame, total: int, steps: int) -> DataFrame:
    """node, betweenness: sums over all sources, made in tasks that have all links each."""
    cores = links.sparkSession.sparkContext.defaultParallelism
    tasks = min(TASKS_PER_CORE * cores, 1 + steps // STEPS_PER_TASK)
    packed = cut_lineage(links.mapInArrow(_packed, "starts binary, ends binary"))
    copies = packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    own = sources.select("node", F.pmod(F.xxhash64("node"), F.lit(tasks)).cast("int").alias("_task"))
    dealt = copies.unionByName(own, allowMissingColumns=True).repartitionById(tasks, "_task")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends, mine = [], [], []
        for b in batches:
            for held, name in ((starts, "starts"), (ends, "ends")):
                held += [np.frombuffer(x, dtype=np.int32) for x in b.column(name).drop_null().to_pylist()]
            mine.append(b.column("node").drop_null().to_numpy())
        mine = np.sort(np.concatenate(mine)) if mine else np.zeros(0, dtype=np.int64)
        if not len(mine):
            return
        graph = _by_end(starts, ends, total), _by_end(ends, starts, total)
        del starts, ends
        sums = np.zeros(total)
        together = max(1, _CELLS // total)
        for k in range(0, len(mine), together):
            _add_dependencies(sums, mine[k:k + together], *graph)
        for k in range(0, total, _STEPS):
            some = sums[k:k + _STEPS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(some))), pa.array(some)], names=["node", "betweenness"])

    return dealt.select("node", "starts", "ends").mapInArrow(walk, "node long, betweenness double").groupBy("node").agg(
        F.sum("betweenness").alias("betweenness")
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links as the bytes of their numbers, some at a time."""
    held, rows = [], 0

    def out():
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int32).tobytes() for c in ("src", "dst")]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["starts", "ends"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= _STEPS:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


Ends = tuple[np.ndarray, np.ndarray]


def _by_end(ends: list[np.ndarray], others: list[np.ndarray], total: int) -> Ends:
    """Links in the order of one end: where those of each node begin, and the other ends. Filled in one pack of links after another."""
    counts = np.zeros(total + 1, dtype=np.int64)
    for e in ends:
        counts[1:] += np.bincount(e, minlength=total)
    first = np.cumsum(counts)
    free, out = first[:-1].copy(), np.empty(first[-1], dtype=np.int32)
    for e, o in zip(ends, others):
        order = np.argsort(e, kind="stable")
        e, begins = e[order], np.flatnonzero(np.r_[True, np.diff(e[order]) != 0])
        runs = np.diff(np.r_[begins, len(e)])
        out[free[e] + np.arange(len(e)) - np.repeat(begins, runs)] = o[order]
        free[e[begins]] += runs
    return first, out


def _links_of(cells: np.ndarray, total: int, side: Ends) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The links of cells (source * total + node), which all have some, a bounded number at a time: cells, their number of links
    here, and the cells that these lead to."""
    first, others = side
    node = cells % total
    begin, degree = first[node], first[node + 1] - first[node]
    until = np.cumsum(degree)
    for low in range(0, int(until[-1]) if len(until) else 0, _STEPS):
        high = min(low + _STEPS, int(until[-1]))
        a, b = (int(np.searchsorted(until, x, "right")) for x in (low, high - 1))
        some = slice(a, b + 1)
        left, start = degree[some].copy(), begin[some].copy()
        # Links of the first cell before these, and of the last one behind them.
        skipped = low - (until[a] - degree[a])
        start[0] += skipped
        left[0] -= skipped
        left[-1] -= until[b] - high
        ranks = np.arange(high - low) + np.repeat(start - (np.cumsum(left) - left), left)
        yield some, left, others[ranks] + np.repeat(cells[some] - node[some], left)


def _sums_there(
    cells: np.ndarray, values: np.ndarray, total: int, side: Ends, depth: np.ndarray, wanted: int, into: np.ndarray, met: list | None = None
) -> None:
    """Adds the cells' values to ``into`` at the cells of the wanted depth that their links lead to; ``met`` gets these, some repeatedly."""
    for some, links, to in _links_of(cells, total, side):
        right = depth[to] == wanted
        to = to[right]
        np.add.at(into, to, np.repeat(values[some], links)[right])
        if met is not None:
            met.append(to)


def _sums_here(cells: np.ndarray, total: int, side: Ends, depth: np.ndarray, wanted: int, values: np.ndarray) -> np.ndarray:
    """For each cell the sum of ``values`` of the cells of the wanted depth that its links lead to."""
    sums = np.zeros(len(cells))
    for some, links, to in _links_of(cells, total, side):
        found = np.where(depth[to] == wanted, values[to], 0.0)
        # No piece is empty.
        sums[some] += np.add.reduceat(found, np.cumsum(links) - links)
    return sums


def _add_dependencies(sums: np.ndarray, sources: np.ndarray, out: Ends, into: Ends) -> None:
    """Adds to ``sums`` what the shortest paths from the sources give each node. A level is walked from whichever of its ends has
    fewer links to look at."""
    total = len(sums)
    degree = [side[0][1:] - side[0][:-1] for side in (out, into)]
    cells = len(sources) * total
    depth, paths = np.full(cells, -1, dtype=np.int32), np.zeros(cells)
    level = np.arange(len(sources)) * total + sources
    depth[level], paths[level] = 0, 1.0
    levels = []
    while len(level):
        levels.append(level)
        here, level = level[degree[0][level % total] > 0], np.zeros(0, dtype=np.int64)
        if not len(here):
            break
        steps = int(degree[0][here % total].sum())
        if steps > cells:
            unknown = np.flatnonzero(depth < 0)
            unknown = unknown[degree[1][unknown % total] > 0]
            if int(degree[1][unknown % total].sum()) < steps:
                found = _sums_here(unknown, total, into, depth, len(levels) - 1, paths)
                level = unknown[found > 0]
                paths[level] = found[found > 0]
                depth[level] = len(levels)
                continue
        # Where they are many, looking at all cells is faster than putting those met in order.
        met = [] if steps < cells // 16 else None
        _sums_there(here, paths[here], total, out, depth, -1, paths, met)
        level = np.flatnonzero((depth < 0) & (paths > 0)) if met is None else np.unique(np.concatenate(met))
        depth[level] = len(levels)
    share = np.zeros(cells)
    gained = np.zeros(len(levels[-1]))
    for at in range(len(levels) - 2, 0, -1):
        below, level = levels[at + 1], levels[at]
        values = (1.0 + gained) / paths[below]
        has = degree[0][level % total] > 0
        gained = np.zeros(len(level))
        if int(degree[1][below % total].sum()) < int(degree[0][level % total].sum()):
            received = share
            received[level] = 0.0
            _sums_there(below, values, total, into, depth, at, received)
            gained = paths[level] * received[level]
        else:
            share[below] = values
            gained[has] = paths[level[has]] * _sums_here(level[has], total, out, depth, at + 1, share)
        np.add.at(sums, level % total, gained)
    # The last level leads nowhere.


def _blocks(links: DataFrame, rows: int, start: str, end: str, rows_per_piece: int | None):
    """Links in blocks of bounded size (_block, starts, ends), and a function that brings rows of a node to the blocks of its links."""
    cut, copy = split_hot(links, start, end, min(rows_per_piece or LINKS_PER_TASK, LINKS_PER_TASK), known_rows=rows)
    blocks = max(1, -(-2 * rows // LINKS_PER_TASK)) if rows > LINKS_PER_TASK else 1
    block = lambda node: F.pmod(F.xxhash64(node, "_piece"), F.lit(blocks))
    packed = cut.groupBy(block(start).alias("_block")).agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_l"))
    table = cut_lineage(packed.select("_block", F.col("_l.a").alias("starts"), F.col("_l.b").alias("ends")))
    return table, lambda front: copy(front, "node").withColumn("_block", block("node"))


def _sums_over_links(key, front: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """For each source and end of a link, the sum of the values that the link's starts have."""
    if not len(front) or not len(links):
        return pd.DataFrame({"source": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "value": pd.Series(dtype="float64")})
    nodes, at_node = np.unique(front["node"].to_numpy(), return_inverse=True)
    sources, at_source = np.unique(front["source"].to_numpy(), return_inverse=True)
    values = np.zeros((len(nodes), len(sources)))
    values[at_node, at_source] = front["value"].to_numpy()
    start, end = (np.concatenate(links[c].tolist()) for c in ("starts", "ends"))
    at = np.minimum(np.searchsorted(nodes, start), len(nodes) - 1)
    known = nodes[at] == start
    order = np.argsort(end[known], kind="stable")
    at, end = at[known][order], end[known][order]
    to, first = np.unique(end, return_index=True)
    out = np.zeros((len(to), len(sources)))
    target = np.repeat(np.arange(len(to)), np.diff(np.append(first, len(end))))
    for k in range(0, len(end), _LINKS_AT_ONCE):
        own = target[k:k + _LINKS_AT_ONCE]
        steps = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[steps]] += np.add.reduceat(values[at[k:k + _LINKS_AT_ONCE]], steps, axis=0)
    row, column = np.nonzero(out)
    return pd.DataFrame({"source": sources[column], "node": to[row], "value": out[row, column]})


def _step(front: DataFrame, side, groups: int) -> DataFrame:
    """source, node, value: the values of ``front`` summed over all links that lead from its nodes."""
    table, to_blocks = side
    rows = to_blocks(front).withColumn("_group", F.pmod(F.xxhash64("source"), F.lit(groups)))
    copies = table.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys = ["_block", "_group"]
    found = rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(_sums_over_links, "source long, node long, value double")
    return found.groupBy("source", "node").agg(F.sum("value").alias("value"))


def _dependencies(starts: DataFrame, forward, backward, groups: int) -> DataFrame:
    levels = [cut_lineage(starts)]
    visited = levels[0].select("source", "node")
    while True:
        reached = _step(levels[-1].withColumnRenamed("paths", "value"), forward, groups).withColumnRenamed("value", "paths")
        fresh = cut_lineage(reached.join(visited, ["source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        visited = visited.unionByName(fresh.select("source", "node"))
    dependency = levels[-1].withColumn("dependency", F.lit(0.0))
    gathered = dependency.select("node", "dependency")
    for level in reversed(levels[1:-1]):
        share = ((1.0 + F.col("dependency")) / F.col("paths")).alias("value")
        received = _step(dependency.select("source", "node", share), backward, groups).withColumnRenamed("value", "share")
        here = level.join(received, ["source", "node"], "left")
        dependency = cut_lineage(
            here.select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dependency"))
        )
        gathered = gathered.unionByName(dependency.select("node", "dependency"))
    return cut_lineage(gathered.groupBy("node").agg(F.sum("dependency").alias("betweenness")))
