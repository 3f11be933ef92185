"""Repeated word windows removed by matching statistics over suffix automata of earlier text.

A window of 20 words is removed if its words also start earlier. Content-chosen anchors cut every document into the words around
each anchor, such that equal windows lie around equal anchors; only anchors that occur twice or more go on. Words around an
anchor that are alike as a whole need one comparison: all but the first go. What differs is a shard, the reference being the
shard's earlier text: documents are streamed through its suffix automaton in their order, matched windows are marked, and the
text is then added to the automaton. Shards of very frequent anchors are parted by window instead, so no shard grows with the
corpus; the automata travel with the shuffle and not by broadcast, as all documents together are the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import RangeHashes, anchors, back_to_rows, filled, in_order, merged, mixed, prepare, repeated_keys, slices, split_words, word_hashes
from talewind.session import cut_lineage

WINDOW, GRAM = 20, 6
#: Different texts around one anchor that a shard holds at most.
SHARD = 400
ANCHORS = "doc_id long, at int, lo int, hi int, gram long, around long"


class SuffixAutomaton:
    """All substrings of the texts added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: list[int]) -> None:
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            made, p = self._state(self.length[last] + 1, {}, 0), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = made
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = made

    def matches(self, text: list[int]) -> list[int]:
        """Matching statistics: for each place, how many words up to it also stand in the texts added."""
        state, n, out = 0, 0, []
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


def covered(matched: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans of words that matched windows cover."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(matched):
        if n >= window:
            if out and out[-1][1] >= i + 1 - window:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i + 1 - window, i + 1))
    return out


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            codes, starts, words = split_words(batch.column("text"))
            values = word_hashes(words)[codes]
            at, own, lo, hi = anchors(values, starts, window, gram)
            doc = np.searchsorted(starts, at, side="right") - 1
            around = RangeHashes(values, np.uint64(0xD1342543DE82EF95))(at - hi, at - lo + window) if len(at) else own
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32)), pa.array(lo.astype(np.int32)),
                pa.array(hi.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(mixed(around + hi.astype(np.uint64)).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ANCHORS.split(", ")])

    return cut_lineage(docs.mapInArrow(read, ANCHORS))


def _segments(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The words around anchors as numbers: shard, doc_id, begin, words. Of ``split`` anchors each window is one."""
    of = places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "lo", "hi", "gram", "split")).alias("places"))
    names = ["shard", "doc_id", "begin", "words"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, starts, words = split_words(batch.column("text"))
            values = word_hashes(words)[codes]
            rows = ([], [], [], [])
            for doc, first, own in zip(batch.column("doc_id").to_pylist(), starts.tolist(), batch.column("places").to_pylist(), strict=False):
                for x in own:
                    begin, end = x["at"] - x["hi"], x["at"] - x["lo"] + window
                    for a in range(begin, end - window + 1) if x["split"] else (begin,):
                        part = values[first + a : first + (a + window if x["split"] else end)]
                        shard = int(mixed(RangeHashes(part)(np.array([0]), np.array([len(part)]))).view(np.int64)[0]) if x["split"] else x["gram"]
                        for to, value in zip(rows, (shard, doc, a, part.tobytes()), strict=True):
                            to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    return cut_lineage(docs.join(of, "doc_id").select("doc_id", "text", "places").mapInArrow(read, "shard long, doc_id long, begin int, words binary"))


def _streamed(segments: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, begin, end) of each shard's segments that its earlier ones hold."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, None
        for batch in batches:
            rows = ([], [], [])
            for key, doc, begin, words in zip(*(batch.column(x).to_pylist() for x in ("shard", "doc_id", "begin", "words")), strict=True):
                text = np.frombuffer(words, np.uint64).tolist()
                if key != shard or automaton is None:
                    shard, automaton = key, SuffixAutomaton()
                else:
                    for a, b in covered(automaton.matches(text), window):
                        for to, x in zip(rows, (doc, begin + a, begin + b), strict=True):
                            to.append(x)
                automaton.add(text)
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "begin", "end"])

    # A shard's rows come one after the other in the order of documents.
    dealt = segments.repartition("shard").sortWithinPartitions("shard", "doc_id", "begin")
    return cut_lineage(dealt.mapInArrow(stream, "doc_id long, begin int, end int"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Spans of words (doc_id, begin, end) that together cover every window whose words start earlier. doc_id: unique, not null."""
    places = _anchored(docs.select("doc_id", "text"), window, gram)
    places = cut_lineage(places.join(repeated_keys(places, "gram").select("gram"), "gram", "left_semi"))
    alike = cut_lineage(places.groupBy("gram", "around").agg(F.min(F.struct("doc_id", "at", "lo", "hi")).alias("first")))
    later = places.join(alike, ["gram", "around"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    spans = later.select("doc_id", (F.col("at") - F.col("hi")).alias("begin"), (F.col("at") - F.col("lo") + window).alias("end"))
    several = cut_lineage(alike.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    open_ = alike.join(several, "gram").select("first.*", "gram", (F.col("n") > shard).alias("split"))
    segments = _segments(docs, cut_lineage(open_), window)
    # Windows of very frequent anchors that are alike: all but the first go; each shard keeps one row of each.
    ranked = segments.groupBy("shard", "words").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count("*").alias("n"))
    ranked = cut_lineage(ranked)
    again = segments.join(ranked.filter("n > 1"), ["shard", "words"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("begin") != F.col("first.begin")))
    again = again.select("doc_id", "begin", (F.col("begin") + F.length("words") / 8).cast("int").alias("end"))
    firsts = ranked.select("shard", "first.doc_id", "first.begin", "words")
    return cut_lineage(spans).unionByName(cut_lineage(again)).unionByName(_streamed(firsts, window))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of ``docs`` (doc_id, text).

    Windows are judged on the input, by smaller doc_id or earlier start. A null text has no words. Rows of one id and text are one
    document and get the same result; rows of one id and different texts come in the order of a hash of the text; null ids come
    first. An empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    own, named = in_order(docs)
    spans = repeated_spans(own, window, gram, shard)
    of = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, starts, words = split_words(filled(batch.column("text")))
            change = np.zeros(len(codes) + 1, np.int64)
            found = batch.column("spans")
            for i in np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False)).tolist():
                ranges = found[i].values
                begin, end = merged(*(ranges.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)))
                np.add.at(change, starts[i] + begin, 1)
                np.add.at(change, starts[i] + end, -1)
            keep = np.cumsum(change)[: len(codes)] == 0
            until = np.concatenate([[0], np.cumsum(keep)])[starts]
            lists = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), words.take(pa.array(codes[keep])))
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(until)), pc.binary_join(lists, " ")], ["doc_id", "n_words", "n_removed", "kept"]
            )

    rows = own.join(of, "doc_id", "left").mapInArrow(read, "doc_id long, n_words long, n_removed long, kept string")
    return back_to_rows(rows, named).select("doc_id", "n_words", "n_removed", "kept")
