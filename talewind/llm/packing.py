"""Token sequences of one length from documents of any length: first fit and best fit by decreasing length.

Both cut a document after every ``capacity`` ids, so nothing is lost; full pieces are sequences already. The rest pieces are
dealt into random groups of about ``GROUP`` rows, a bound on what one task holds, and each group is packed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import prepare
from talewind.llm.tokens import encoded
from talewind.session import cut_lineage

CAPACITY = 4096
#: Rest pieces in a group on average. A piece has at most CAPACITY ids, so a group has at most some 16 MB of them.
GROUP = 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` ids, with a number for each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, starts in encoded(batches, path):
            rows = ([], [], [], [], [])
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1], starts[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                own = own.astype("<u2" if own.max() < 1 << 16 else "<u4")
                for s in range(0, len(own), capacity):
                    piece = own[s : s + capacity]
                    for to, x in zip(rows, (doc, s, len(piece), len(own), piece.tobytes()), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    prepare(docs.sparkSession)
    made = docs.select("doc_id", "text").mapInArrow(cut, PIECES)
    # Written: encoding is the dear part and is not done again if an executor is lost; row numbers are fixed from here on.
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


class FirstFit:
    """A tournament tree over bins in order of opening; a node holds the most free places among its bins."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``."""
        free, at = self.free, 1
        while at < self.size:
            at *= 2
            if free[at] < need:
                at += 1
        free[at] -= need
        leaf, at = at, at >> 1
        while at:
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
            at >>= 1
        return leaf - self.size


class BestFit:
    """A segment tree over free places: which capacities have an open bin. A search gives the fullest bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.capacity, self.size, self.opened = capacity, 1 << capacity.bit_length(), 0
        self.count = [0] * (2 * self.size)
        self.at: dict[int, list[int]] = {}

    def _add(self, free: int, n: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def _least(self, need: int) -> int | None:
        """The least capacity from ``need`` on that has a bin."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        if at == 1:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size

    def place(self, need: int) -> int:
        free = self._least(need)
        if free is None:
            free, bin_ = self.capacity, self.opened
            self.opened += 1
        else:
            bin_ = self.at[free].pop()
            self._add(free, -1)
        self.at.setdefault(free - need, []).append(bin_)
        self._add(free - need, 1)
        return bin_


def wide(ids: bytes, length: int) -> np.ndarray:
    """Ids of a piece, which are kept with two bytes each where that is enough."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")


def _placed(table: pa.Table, capacity: int, fit: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a group. A sequence is named by twice the row number of its first piece."""
    length, row = table.column("length").to_numpy(), table.column("row").to_numpy()
    bins, first, used = fit(len(row), capacity), {}, {}
    seq, offset = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for i in np.lexsort((row, -length)).tolist():
        n = int(length[i])
        b = bins.place(n)
        seq[i] = first.setdefault(b, 2 * int(row[i]))
        offset[i] = used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return seq, offset


def _packed(docs: DataFrame, path: str, end_id: int, capacity: int, group: int, fit: Callable, emit: Callable, out: str) -> DataFrame:
    """Pack and give each group's pieces to ``emit`` (table, seq, offset); full pieces come as groups of their own."""
    pieces = pieces_of(docs, path, end_id, capacity)
    rests = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group))

    def pack(table: pa.Table) -> pa.Table:
        return emit(table, *_placed(table, capacity, fit))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            yield from emit(pa.Table.from_batches([batch]), 2 * row + 1, np.zeros(len(row), np.int64)).to_batches()

    # Dealt by row and not by key, so that repeated rows don't meet in one group.
    small = rests.withColumn("_g", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("_g").applyInArrow(lambda table: pack(table), out)
    return small.unionByName(pieces.filter(F.col("length") >= capacity).mapInArrow(alone, out))


def packed_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """First-fit decreasing packing in random groups: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32
    bit), sequence_id, offset.

    Each id of a document lies in one piece. A null or empty text is ``end_id`` alone; a null doc_id stays null; repeated rows
    are packed each by itself; an empty table gives no rows. Other columns are not read. Pieces of equal length are taken in
    the order of their row numbers.
    """

    def emit(table: pa.Table, seq: np.ndarray, offset: np.ndarray) -> pa.Table:
        ids = [wide(x, n).tobytes() for x, n in zip(table.column("ids").to_pylist(), table.column("length").to_pylist(), strict=True)]
        own = table.select(["doc_id", "start", "length", "doc_tokens"]).append_column("ids", pa.array(ids, pa.binary()))
        return own.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return _packed(docs, path, end_id, capacity, group, FirstFit, emit, f"{PIECES}, sequence_id long, offset long")


MATRIX = (
    "sequence_id long, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>,"
    " input_ids binary"
)


def packed_matrix(docs: DataFrame, path: str, end_id: int, pad_id: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Best-fit decreasing packing, one row per sequence of exactly ``capacity`` ids.

    sequence_id; input_ids (binary: a row of the id matrix, little-endian unsigned 32 bit, padded with ``pad_id``); n_tokens
    before the padding; cu_seqlens (0 and the cumulative lengths of the segments); position_resets (where positions begin at 0
    again: the segments' first places); doc_ids and doc_starts of the segments in their order.

    Documents longer than a sequence are cut without loss: their pieces have increasing doc_starts. A null or empty text is
    ``end_id`` alone, a null doc_id stays null, repeated rows are packed each by itself, an empty table gives no rows.
    """

    def emit(table: pa.Table, seq: np.ndarray, offset: np.ndarray) -> pa.Table:
        order = np.lexsort((offset, seq))
        doc, start, length, ids = (table.column(x).to_pylist() for x in ("doc_id", "start", "length", "ids"))
        rows: dict[str, list] = {x.split()[0]: [] for x in MATRIX.split(", ")}
        for own in np.split(order, np.flatnonzero(np.diff(seq[order])) + 1):
            own = own.tolist()
            if not own:
                continue
            begin = [int(offset[i]) for i in own]
            n = begin[-1] + length[own[-1]]
            matrix = np.full(capacity, pad_id, "<u4")
            for i, a in zip(own, begin, strict=True):
                matrix[a : a + length[i]] = wide(ids[i], length[i])
            made = (int(seq[own[0]]), n, [*begin, n], begin, [doc[i] for i in own], [start[i] for i in own], matrix.tobytes())
            for x, value in zip(rows.values(), made, strict=True):
                x.append(value)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.table({name: pa.array(x, kind) for (name, x), kind in zip(rows.items(), kinds, strict=True)})

    return _packed(docs, path, end_id, capacity, group, BestFit, emit, MATRIX)


def write_matrix(rows: DataFrame, to: str) -> None:
    """Write sequences as binary files a training job can read whole: parquet parts of equal rows' width."""
    rows.write.mode("errorifexists").parquet(to)
