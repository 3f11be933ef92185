"""Repeated byte windows found by a radix sort that is limited in depth and goes from the most significant digit down.

Ordering all suffixes through 200 bytes would shuffle each byte's suffix. Instead suffixes are sorted by digits of falling size,
and only groups that still hold repeats of unknown extent go on. The first digit is a content-chosen gram of 40 bytes, the anchor
that owns a window: equal windows have equal anchors at equal distances. The next digit is all that the anchor's windows span;
where it is equal, all of them are repeated at once. The others are ordered by the windows' common bytes for 32 distances, then 4,
then 1 at a time; at depth 1 the group is one string of 200 bytes. Groups of equal strings are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import RangeHashes, anchors, back_to_rows, in_order, merged, mixed, prepare, raw_bytes, repeated_keys, slices
from talewind.session import cut_lineage

WINDOW, GRAM = 200, 40
#: How many distances from window to anchor a digit covers, from pass to pass; each divides the one before.
PASSES = (32, 4, 1)
#: A 64-bit number for each byte.
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER = np.uint64(0xD1342543DE82EF95)
ANCHORS = "doc_id long, at int, lo int, hi int, gram long, around long"


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            data, starts = raw_bytes(batch.column("text"))
            values = TABLE[data]
            at, own, lo, hi = anchors(values, starts, window, gram)
            doc = np.searchsorted(starts, at, side="right") - 1
            around = RangeHashes(values, _OTHER)(at - hi, at - lo + window) if len(at) else own
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32)), pa.array(lo.astype(np.int32)),
                pa.array(hi.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(mixed(around + hi.astype(np.uint64)).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ANCHORS.split(", ")])

    return cut_lineage(docs.mapInArrow(read, ANCHORS))


def _members(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The bytes that an anchor's windows span: row, doc_id, at, lo, hi, times, bytes."""
    of = places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "lo", "hi", "times")).alias("places"))
    kinds = {"doc_id": pa.int64(), "at": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "times": pa.int64(), "bytes": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts = raw_bytes(batch.column("text"))
            whole, rows = data.tobytes(), {k: [] for k in kinds}
            for doc, first, own in zip(batch.column("doc_id").to_pylist(), starts.tolist(), batch.column("places").to_pylist(), strict=False):
                for x in own:
                    part = whole[first + x["at"] - x["hi"] : first + x["at"] - x["lo"] + window]
                    for k, value in zip(kinds, (doc, x["at"], x["lo"], x["hi"], x["times"], part), strict=True):
                        rows[k].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], list(kinds))

    made = docs.join(of, "doc_id").select("doc_id", "text", "places").mapInArrow(read, "doc_id long, at int, lo int, hi int, times long, bytes binary")
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


DIGITS = "row long, doc_id long, at int, node int, least int, most int, times long, core long, full long"


def _digits(members: DataFrame, width: int, coarser: int, window: int) -> DataFrame:
    """Each member's digits of ``width`` distances: those its windows have, within the coarser digit ``node`` if there is one.

    core: the bytes that all windows of the digit share, whoever owns them; full: the bytes of the windows that the member owns.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            offsets = np.frombuffer(batch.column("bytes").buffers()[1], np.int32)[batch.column("bytes").offset :][: batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(batch.column("bytes").buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if batch.num_rows else np.zeros(0, np.uint8)
            values = TABLE[data]
            lo, hi = (batch.column(x).to_numpy().astype(np.int64) for x in ("lo", "hi"))
            place = offsets[:-1] - offsets[0] + hi
            if coarser:
                node = batch.column("node").to_numpy().astype(np.int64)
                lo, hi = np.maximum(lo, node * coarser), np.minimum(hi, node * coarser + coarser - 1)
            n = hi // width - lo // width + 1
            i = np.repeat(np.arange(len(n)), n)
            digit = lo[i] // width + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            least, most = np.maximum(lo[i], digit * width), np.minimum(hi[i], digit * width + width - 1)
            far = np.minimum(digit * width + width - 1, window - GRAM)
            one, two = RangeHashes(values), RangeHashes(values, _OTHER)
            core = mixed(one(place[i] - digit * width, place[i] - far + window) + digit.astype(np.uint64))
            full = mixed(two(place[i] - most, place[i] - least + window) + (least * 256 + most).astype(np.uint64))
            columns = [
                *(batch.column(x).take(pa.array(i)) for x in ("row", "doc_id", "at")), *(pa.array(x.astype(np.int32)) for x in (digit, least, most)),
                batch.column("times").take(pa.array(i)), pa.array(core.view(np.int64)), pa.array(full.view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGITS.split(", ")])

    return cut_lineage(members.mapInArrow(read, DIGITS))


def _decided(rows: DataFrame, core: str, full: str, least: list[str]) -> DataFrame:
    """For each (core, full): how often it occurs, its first row, and whether the group of ``core`` has strings that differ of which
    some occur once; only such groups hold repeats of unknown extent."""
    alike = cut_lineage(rows.groupBy(core, full).agg(F.sum("times").alias("n"), F.min(F.struct(*least)).alias("first")))
    groups = alike.groupBy(core).agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    open_ = cut_lineage(groups.filter("kinds > 1 and single > 0").select(core, F.lit(True).alias("open")))
    return cut_lineage(alike.join(open_, core, "left").filter("n > 1 or open"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """Spans of bytes (doc_id, begin, end) that together cover every window that also starts elsewhere. doc_id: unique."""
    docs = docs.select("doc_id", "text")
    places = _anchored(docs, window, gram)
    places = places.join(repeated_keys(places, "gram").select("gram"), "gram", "left_semi").withColumn("times", F.lit(1).cast("long"))
    places = cut_lineage(places)
    span = [(F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + window).alias("end")]
    known = _decided(places, "gram", "around", ["doc_id", "at"])
    met = places.withColumnsRenamed({"lo": "least", "hi": "most"}).join(known.filter("n > 1").select("gram", "around"), ["gram", "around"])
    spans = [cut_lineage(met.select("doc_id", *span))]
    # Of equal rows one goes on and stands for two, which is as good as more.
    firsts = known.filter("open").select("gram", "around", "first.doc_id", "first.at", F.least("n", F.lit(2)).alias("times"))
    on = places.drop("times", "gram", "around").join(firsts, ["doc_id", "at"])
    members = _members(docs, cut_lineage(on.select("doc_id", "at", "lo", "hi", "times")), window)
    rows, coarser = members, 0
    for width in passes:
        digits = _digits(rows, width, coarser, window)
        known = _decided(digits, "core", "full", ["row", "node"])
        both = digits.join(known.select("core", "full", "n", "first", "open"), ["core", "full"])
        spans.append(cut_lineage(both.filter("n > 1 and times = 1").select("doc_id", *span)))
        if width == passes[-1]:
            break
        left = both.filter((F.col("row") == F.col("first.row")) & (F.col("node") == F.col("first.node")) & F.col("open"))
        left = left.select("row", "node", F.least("n", F.lit(2)).alias("times"))
        rows, coarser = cut_lineage(members.drop("times").join(left, "row")), width
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for each row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``window`` UTF-8 bytes that also starts anywhere else goes, judged on the input. A null text
    is empty. Repeated rows of one id and text repeat each other; rows of one id and different texts are different documents; a
    null id stays null. An empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    own, named = in_order(docs)
    of = repeated_spans(own, window).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rows = own.join(of, "doc_id", "left")
    # Rows that come several times repeat as a whole.
    several = F.lit(False) if named is None else F.coalesce(F.col("times") > 1, F.lit(False))
    if named is not None:
        rows = rows.join(named.select(F.col("number").alias("doc_id"), "times"), "doc_id")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts = raw_bytes(batch.column("text"))
            size, removed, runs, found = np.diff(starts), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), batch.column("spans")
            whole, kept = data.tobytes(), []
            there = pc.is_valid(found).to_numpy(zero_copy_only=False)
            for i, (a, b, all_of) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), batch.column("several").to_pylist(), strict=True)):
                if all_of and b - a >= window:
                    removed[i], runs[i] = b - a, 1
                    kept.append(b"")
                elif there[i]:
                    ranges = found[i].values
                    begin, end = merged(*(ranges.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)))
                    removed[i], runs[i] = (end - begin).sum(), len(begin)
                    kept.append(b"".join(whole[a + x : a + y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), b - a], strict=True)))
                else:
                    kept.append(whole[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], [x.split()[0] for x in out.split(", ")]
            )

    rows = rows.select("doc_id", "text", "spans", several.alias("several")).mapInArrow(read, out)
    return back_to_rows(rows, named).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
