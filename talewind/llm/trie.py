"""Prefix trie of conversations from sorted matrices of turn ids, in shards by range.

A turn (role, text) becomes two 64-bit numbers. Equal conversations become one row with their count. Rows are dealt to shards by
ranges of their ids, so every node lies in one shard or at the borders of neighbouring ones. A shard sorts its rows with numpy
(lexsort over a padded matrix of some columns, then of the next ones for the rows that go on), marks where a column differs from the row
before, and ORs the marks along the columns: a set mark starts a node. reduceat over the marked cells then sums
up every node of every depth at once.

Nodes on the paths of a shard's first and last row may go on in its neighbours. They are carried, with what their finished children
amount to, to the next level, where the border rows of FAN shards are the rows of the same routine; the last level has them all.
Only border rows travel, two of each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import WORD, prepare
from talewind.session import cut_lineage

#: Turns of a shard, about; columns of a padded matrix; shards whose borders are joined in one group.
CELLS, COLUMNS, FAN = 400_000, 16, 64
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
CARRY = "shard long, turns array<long>, words array<long>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
_SUMS = ("n", "kids", "leaves", "saved")


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), hi, lo, words for each turn, in the order of turn (null first), role, text.

    Rows are sorted in ranges, so a conversation of any length is numbered by many tasks; what its earlier ranges hold is added after.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    start = F.substring("text", 1, 64)
    dealt = rows.repartitionByRange(parts, "conv_id", F.col("turn").asc_nulls_first(), "role", start)
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    one = dealt.select(
        "conv_id", F.xxhash64("role", "text").alias("hi"), F.xxhash64(F.lit(1), "text", "role").alias("lo"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                place[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(len(conv), part), pa.int64())], [*batch.schema.names, "place", "part"])

    placed = cut_lineage(one.mapInArrow(number, "conv_id long, hi long, lo long, words long, place long, part long"))
    # A conversation in several ranges: at most one goes over each border.
    pieces = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    over = pieces.join(pieces.groupBy("conv_id").count().filter("count > 1").select("conv_id"), "conv_id")
    x, y = over.alias("x"), over.alias("y")
    before = x.join(y, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("y.part") < F.col("x.part")))
    before = before.groupBy("x.conv_id", "x.part").agg(F.sum("y.n").alias("before"))
    joined = placed.join(F.broadcast(before), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "hi", "lo", "words")


def rebuilt(placed: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The same columns after each conversation c took the first crc32(c) % heads turns of conversation c - c % every in place of its
    own first ones, and a row with place -1 for each conversation, also without turns."""
    placed = cut_lineage(placed)
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = F.col("conv_id")
    convs = cut_lineage(convs.select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"), (c - c % every).alias("base")))
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    plan = convs.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"))
    plan = cut_lineage(plan)
    own = placed.join(plan, "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "hi", "lo", "words")
    # At most ``heads`` turns of a base for at most ``every`` conversations.
    first = placed.filter(F.col("place") < heads - 1).withColumnRenamed("conv_id", "base")
    borrowed = first.join(plan, "base").filter("place < h").select("conv_id", "place", "hi", "lo", "words")
    none = F.lit(None).cast("long")
    return own.unionByName(borrowed).unionByName(plan.select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("hi"), none.alias("lo"), none.alias("words")))


def sequences(rows: DataFrame) -> DataFrame:
    """turns, words, n, least, ends of each distinct conversation: its ids, words of its turns, members, least member, and the
    checksum of all members."""
    turns = F.filter(F.array_sort(F.collect_list(F.struct("place", "hi", "lo", "words"))), lambda x: x["place"] >= 0)
    whole = rows.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.flatten(F.transform("t", lambda x: F.array(x["hi"], x["lo"]))).alias("turns"), F.transform("t", lambda x: x["words"]).alias("words")
    )
    whole = cut_lineage(whole.withColumns({"d": F.xxhash64("turns"), "e": F.xxhash64(F.lit(1), "turns")}))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come in order, and their members; only the checksum of the open one is held."""
        key, out = None, ([], [], [])

        def close() -> None:
            for to, x in zip(out, (least, n, digest.hexdigest()), strict=True):
                to.append(x)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["conv_id", "n", "ends"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for d, e, conv in zip(*(batch.column(x).to_pylist() for x in ("d", "e", "conv_id")), strict=True):
                if (d, e) == key:
                    n += 1
                    digest.update(b",%d" % conv)
                    continue
                if key is not None:
                    close()
                key, least, n, digest = (d, e), conv, 1, hashlib.sha256(b"%d" % conv)
            yield made()
        if key is not None:
            close()
            yield made()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = whole.select("d", "e", "conv_id").repartition(parts, "d", "e").sortWithinPartitions("d", "e", "conv_id")
    groups = alike.mapInArrow(members, "conv_id long, n long, ends string")
    return whole.select("conv_id", "turns", "words").join(groups, "conv_id").select("turns", "words", "n", F.col("conv_id").alias("least"), "ends")


class Rows:
    """Rows of a matrix, ragged: ``lengths`` turns each (ids hi and lo, words), and for depths 0 to length the values of cells."""

    def __init__(self, lengths: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, cells: dict[str, np.ndarray], ends: list):
        self.lengths, self.hi, self.lo, self.words, self.cells, self.ends = lengths, hi, lo, words, cells, ends
        self.at = np.concatenate([[0], np.cumsum(lengths)])

    def ids(self) -> np.ndarray:
        """Small numbers from 1 in the order of (hi, lo)."""
        order = np.lexsort((self.lo, self.hi))
        hi, lo, out = self.hi[order], self.lo[order], np.zeros(len(order), np.int64)
        if len(order):
            out[order] = np.cumsum(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return out

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows' order, and for all cells of the rows in that order whether they start a node."""
        ids, n = self.ids(), len(self.lengths)
        order = np.argsort(self.lengths > 0, kind="stable")
        group, marks = np.zeros(n, np.int64), []
        for left in range(0, int(self.lengths.max(initial=0)), COLUMNS):
            active = np.flatnonzero(self.lengths[order] > left)
            rows, depth = order[active], left + np.arange(COLUMNS)
            there = depth < self.lengths[rows][:, None]
            matrix = np.where(there, ids[np.minimum(self.at[rows][:, None] + depth, len(ids) - 1)], 0)
            # Of equal columns, the row that ends here comes first.
            perm = np.lexsort((self.lengths[rows] > left + COLUMNS, *matrix.T[::-1], group[active]))
            order[active], matrix, there = rows[perm], matrix[perm], there[perm]
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= group[active][1:] != group[active][:-1]
            np.logical_or.accumulate(change, axis=1, out=change)
            marks.append((active, left, change, there))
            group[active] = np.cumsum(change[:, -1])
        at = np.concatenate([[0], np.cumsum(self.lengths[order] + 1)])
        start = np.zeros(at[-1], bool)
        start[0] = True
        for active, left, change, there in marks:
            i, j = np.nonzero(there)
            start[at[active[i]] + left + j + 1] = change[i, j]
        return order, start

    def take(self, order: np.ndarray) -> Rows:
        def cut(values: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            to = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
            return values[np.repeat(at[:-1][order] - to, lengths[order]) + np.arange(int(lengths.sum()))]

        at = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        turns = (cut(x, self.at, self.lengths) for x in (self.hi, self.lo, self.words))
        return Rows(self.lengths[order], *turns, {k: cut(v, at, self.lengths + 1) for k, v in self.cells.items()}, self.ends)

    def keys(self, row: int) -> list[bytes]:
        """For each depth, what names the row's node."""
        a, b = self.at[row], self.at[row + 1]
        both, digest, out = np.stack([self.hi[a:b], self.lo[a:b]], axis=1).astype("<i8"), hashlib.blake2b(digest_size=16), []
        for x in [b"", *(x.tobytes() for x in both)]:
            digest.update(x)
            out.append(digest.digest())
        return [k.to_bytes(4, "big") + x for k, x in enumerate(out)]


def nodes_of(rows: Rows, last: bool, named: bool) -> tuple[dict[str, list], list[dict]]:
    """The finished nodes, and the border rows with what is carried on (none at the last level). named: give all nodes their keys."""
    order, start = rows.sort()
    rows = rows.take(order)
    n_rows = len(rows.lengths)
    at = np.concatenate([[0], np.cumsum(rows.lengths + 1)])
    row = np.repeat(np.arange(n_rows), rows.lengths + 1)
    depth = np.arange(at[-1]) - at[row]
    # All depths one after the other: each node is a run of cells.
    by_depth = np.argsort(depth, kind="stable")
    begin = np.flatnonzero(start[by_depth])
    cell = by_depth[begin]
    summed = {k: np.add.reduceat(rows.cells[k][by_depth], begin) for k in _SUMS}
    least = np.minimum.reduceat(rows.cells["least"][by_depth], begin)
    ends = np.maximum.reduceat(rows.cells["ends"][by_depth], begin)
    node_of = np.empty(len(row), np.int64)
    node_of[by_depth] = np.cumsum(start[by_depth]) - 1
    own_depth, first = depth[cell], row[cell]
    beyond = row[by_depth[np.append(begin[1:], len(row)) - 1]] + 1
    parent = np.where(own_depth > 0, node_of[np.maximum(cell - 1, 0)], -1)
    words = np.where(own_depth > 0, rows.words[np.maximum(rows.at[first] + own_depth - 1, 0)] if len(rows.words) else 0, 0)

    edge = np.zeros(len(begin), bool)
    if not last:
        edge[node_of[at[0] : at[1]]] = edge[node_of[at[-2] :]] = True
    done, child = ~edge, parent >= 0
    kids = summed["kids"] + np.bincount(parent[child & done], minlength=len(begin))
    leaf = summed["leaves"] + (done & (kids == 0))
    saved = summed["saved"] + np.where(done, (summed["n"] - 1) * words, 0)
    # Nodes by first row and depth: what lies below a node follows it.
    before = np.lexsort((own_depth, first))
    place = np.empty(len(begin), np.int64)
    place[before] = np.arange(len(begin))
    end = np.searchsorted(first[before], beyond)
    below = lambda own: (total := np.concatenate([[0], np.cumsum(own[before])]))[end] - total[place]
    all_leaves, all_saved = below(leaf), below(saved)

    keys: dict[int, bytes] = {}
    for r in range(n_rows) if named or last else sorted({0, n_rows - 1}):
        keys.update(zip(node_of[at[r] : at[r + 1]].tolist(), rows.keys(r), strict=True))
    out = np.flatnonzero(done)
    above = parent[out]
    known = (above >= 0) & done[np.maximum(above, 0)]
    finished = {
        "depth": own_depth[out].tolist(), "conv_id": least[out].tolist(),
        "parent_conv_id": [x if k else None for x, k in zip(least[np.maximum(above, 0)].tolist(), known.tolist(), strict=True)],
        "n_convs": summed["n"][out].tolist(), "n_children": kids[out].tolist(), "n_leaves": all_leaves[out].tolist(), "saved_tokens": all_saved[out].tolist(),
        "ends_sha256": [rows.ends[x] if x >= 0 else EMPTY for x in ends[out].tolist()],
        "key": [keys.get(x) if named else None for x in out.tolist()],
        "parent_key": [keys[p] if p >= 0 and not k else None for p, k in zip(above.tolist(), known.tolist(), strict=True)],
    }
    if last:
        return finished, []
    up = child & done
    for values, totals in ((summed["leaves"], all_leaves), (summed["saved"], all_saved)):
        np.add.at(values, parent[up], totals[up])
    summed["kids"] = kids
    carried, taken = [], set()
    for r in sorted({0, n_rows - 1}):
        mine = node_of[at[r] : at[r + 1]]
        free = np.array([x not in taken for x in mine.tolist()])
        taken.update(mine.tolist())
        a, b = rows.at[r], rows.at[r + 1]
        carried.append({
            "turns": np.stack([rows.hi[a:b], rows.lo[a:b]], axis=1).ravel(), "words": rows.words[a:b],
            **{k: np.where(free, summed[k][mine], 0) for k in _SUMS}, "least": np.where(free, least[mine], np.iinfo(np.int64).max),
            "ends": [rows.ends[x] if f and x >= 0 else None for x, f in zip(ends[mine].tolist(), free.tolist(), strict=True)],
        })
    return finished, carried


_NODE_TYPES = [("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
               ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary())]
_CARRY_TYPES = [("shard", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("turns", "words", "n", "least", "kids", "leaves", "saved")), ("ends", pa.list_(pa.string()))]
_BOTH = pa.schema(_NODE_TYPES + _CARRY_TYPES)


def _table(finished: dict[str, list], carried: list[dict], shard: int) -> pa.Table:
    many = len(finished["depth"])
    nodes = [pa.array(finished[k], t) for k, t in _NODE_TYPES] + [pa.nulls(many, t) for _, t in _CARRY_TYPES]
    rows = [{"shard": shard, **{k: list(v) for k, v in c.items()}} for c in carried]
    borders = [pa.nulls(len(rows), t) for _, t in _NODE_TYPES] + [pa.array([r[k] for r in rows], t) for k, t in _CARRY_TYPES]
    return pa.concat_tables([pa.Table.from_arrays(nodes, schema=_BOTH), pa.Table.from_arrays(borders, schema=_BOTH)])


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy() if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy()


def _level_rows(table: pa.Table) -> Rows:
    turns = _numbers(table.column("turns"))
    lengths = np.array([len(x) for x in table.column("words").to_pylist()], np.int64)
    texts = [x for row in table.column("ends").to_pylist() for x in row]
    cells = {k: _numbers(table.column(k)) for k in (*_SUMS, "least")}
    cells["ends"] = np.array([i if x is not None else -1 for i, x in enumerate(texts)], np.int64)
    return Rows(lengths, turns[::2], turns[1::2], _numbers(table.column("words")), cells, texts)


def _joined(last: bool):
    """The routine of one level above the shards."""

    def join(table: pa.Table) -> pa.Table:
        return _table(*nodes_of(_level_rows(table), last=last, named=True), table.column("group")[0].as_py())

    return join


def trie(turns: DataFrame, cells: int = CELLS, fan: int = FAN, rebuild: bool = True) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id (the parent's smallest member; null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (see ``sequences``; of an empty string if no conversation ends here).

    turns: conv_id, turn, role, text; other columns are not read. Null roles and texts are empty, null turns come first, turns of one
    number are in the order of role and text, and repeated rows are turns of their own. Rows with a null conv_id are in no conversation.
    Conversations without turns are members of the root. An empty table has no nodes. rebuild: see ``rebuilt``. The ids of one
    conversation (16 bytes a turn) must fit a task; its texts need not.
    """
    prepare(turns.sparkSession)
    placed = in_order(turns)
    if rebuild:
        rows = rebuilt(placed)
    else:
        none = F.lit(None).cast("long")
        rows = placed.unionByName(placed.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("hi"), none.alias("lo"), none.alias("words")))
    seqs = cut_lineage(sequences(rows))
    total = seqs.agg(F.sum(F.size("words") + 1).alias("n")).first().n
    shards = max(1, -(-(total or 0) // cells))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        turns, words = _numbers(table.column("turns")), _numbers(table.column("words"))
        lengths = np.array(pc.list_value_length(table.column("words")).to_numpy(), np.int64)
        per = lengths + 1
        cell = {k: np.zeros(int(per.sum()), np.int64) for k in ("kids", "leaves", "saved")}
        cell |= {k: np.repeat(table.column(k).to_numpy(), per) for k in ("n", "least")}
        cell["ends"] = np.full(int(per.sum()), -1)
        cell["ends"][np.cumsum(per) - 1] = np.arange(len(per))
        rows = Rows(lengths, turns[::2], turns[1::2], words, cell, table.column("ends").to_pylist())
        yield from _table(*nodes_of(rows, last=False, named=False), TaskContext.get().partitionId()).to_batches(max_chunksize=50_000)

    schema = f"{NODE}, {CARRY}"
    made = cut_lineage(seqs.repartitionByRange(shards, "turns").mapInArrow(shard, schema))
    levels, carry = [made], made.filter("shard is not null")
    # With borders of all shards in one group, nothing is left open.
    most = made.agg(F.max("shard").alias("m")).first().m
    while most is not None:
        last = most < fan

        grouped = carry.withColumn("group", F.floor(F.col("shard") / fan))
        made = cut_lineage(grouped.select("group", *(n for n, _ in _CARRY_TYPES)).groupBy("group").applyInArrow(_joined(last), schema))
        levels.append(made)
        if last:
            break
        carry, most = made.filter("shard is not null"), most // fan

    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.filter("depth is not null")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # Nodes that were carried, under their names: those on the border rows of the shards.
    named = nodes.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_of"))
    open_ = nodes.filter("parent_key is not null").drop("parent_conv_id").join(named, "parent_key").withColumnRenamed("_of", "parent_conv_id")
    return nodes.filter("parent_key is null").select(*columns).unionByName(open_.select(*columns))
