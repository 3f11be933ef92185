"""Benchmark passages in documents, found by latent meaning and confirmed by word order.

Passages are windows of a document's words. Their TF-IDF vectors over hashed words are projected on the leading right singular
vectors of a randomised SVD of all passages of all documents: in the pass that counts words, tasks add each passage, with a random
sign, to one of SKETCHED rows; the sum of these rows has the passages' directions and lengths, whatever their number. Every
window of every document is compared with every benchmark item. Pairs of high cosine are confirmed by the longest common
subsequence of words, and by whether the item's answer (its last sentence) is there too.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import filled, mixed, prepare, raw_bytes, slices
from talewind.session import cut_lineage

#: Words are hashed to so many places; RANK singular vectors are kept of OVERSAMPLED ones. 9 MB of model whatever the input.
PLACES, RANK, OVERSAMPLED = 1 << 15, 64, 80
#: Rows that all passages are added up in (32 MB), and how many tasks a core do so: their sums do not grow with the input.
SKETCHED, TASKS = 256, 4
BLOCK, BLOCKS = 24, 2
#: Bytes of text looked at in one step: what is made of them fits a core's cache.
SLICE_BYTES = 1 << 18
#: Items of one model. RANK directions hold an ever smaller share of each item as they must serve more items.
ITEMS = 200
#: Of an item's length, its model keeps so much; below that, the item's gate falls with the share. Items of which less than LEAST
#: is kept get models of their own, of half as many items each time, down to FEWEST.
KEPT, LEAST, FEWEST = 0.5, 0.3, 8
#: Models (of 9 MB) in one pass over the documents.
MODELS = 12
COSINE, LCS, LCS_WITH_ANSWER = 0.2, 0.6, 0.5
#: Numbers in a block of the frequencies, how many such blocks there are, and places in a block of the sketch.
_ROWS, _OF_PLACES = 1 << 10, 1 << 8
_FREQUENCIES = PLACES // _ROWS + 1
#: Places that an item's words are counted in, for a bound of what a window can have of it; windows' words in one step of that.
_BUCKETS, _TOGETHER = 1 << 11, 1 << 18
#: Tasks that the summed sketch is multiplied by.
_PARTS = 2


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_WHITE, _MARKS = _among(" \t\n\v\f\r"), _among(".,;:!?\"'()[]{}*#|<>&%$-_")
_ODD = 0x9E3779B97F4A7C15
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    both = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    for x in both:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return both


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit numbers of ranges of bytes: differences of prefix sums of a polynomial, as in common.RangeHashes; slices of texts are
    about as long as each other, so the powers are kept."""
    n = max(len(data), 2 * SLICE_BYTES - 1) + 1
    up, down = _powers(n) if n == 2 * SLICE_BYTES else _powers.__wrapped__(n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + np.uint64(_ODD))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without the marks around them, and where each text's begin."""
    data, at = raw_bytes(pc.utf8_lower(filled(texts)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    white = _WHITE[data]
    edge[1:] |= white
    begin = np.flatnonzero(edge[:-1] & ~white)
    edge[:-1] |= white
    edge[at] = True
    end = np.flatnonzero(edge[1:] & ~white) + 1
    starts = np.searchsorted(begin, at)
    led, trailed = np.flatnonzero(_MARKS[data[begin]]), np.flatnonzero(_MARKS[data[end - 1]])
    # Most words have a mark or two; longer runs of marks are passed at once.
    for _ in range(3):
        begin[led] += 1
        led = led[begin[led] < end[led]]
        led = led[_MARKS[data[begin[led]]]]
    if len(led):
        plain = np.append(np.flatnonzero(~_MARKS[data]), len(data))
        begin[led] = np.minimum(end[led], plain[np.searchsorted(plain, begin[led])])
    trailed = trailed[begin[trailed] < end[trailed]]
    for _ in range(3):
        end[trailed] -= 1
        trailed = trailed[_MARKS[data[end[trailed] - 1]]]
    if len(trailed):
        plain = np.flatnonzero(~_MARKS[data])
        end[trailed] = plain[np.searchsorted(plain, end[trailed]) - 1] + 1
    return _hashes(data, begin, end), starts


def _places(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) & np.uint64(PLACES - 1)).astype(np.int64)


def _summed(parts: DataFrame) -> DataFrame:
    """Sums of the tasks' arrays: rows of block and 32-bit whole numbers, to 64-bit ones."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("values"))
        return pa.table({"block": table.column("block").slice(0, 1), "values": pa.array([total.tobytes()], pa.binary())})

    return cut_lineage(parts.groupBy("block").applyInArrow(lambda table: add(table), "block int, values binary"))


def counts(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Of documents (doc_id, text, text_key): in how many each place's words occur, the last number being that of all documents;
    and the sketch of their passages, rows of block (of places) and values (of each place, SKETCHED ones).

    A passage's row and sign are drawn by its document and number, so the sketch is the same however rows are dealt to tasks.
    """
    tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sketch = np.zeros(_FREQUENCIES * _ROWS, np.int32), np.zeros(PLACES * SKETCHED, np.int32)
        for batch in slices(batches, most=SLICE_BYTES):
            hashes, starts = _words(batch.column("text"))
            doc, places = np.repeat(np.arange(batch.num_rows), np.diff(starts)), _places(hashes)
            total[:PLACES] += np.bincount(pd.unique(doc * PLACES + places) % PLACES, minlength=PLACES).astype(np.int32)
            total[-1] += batch.num_rows
            begin, text, number = _cut(starts, BLOCK * BLOCKS)
            ids, keys = (pc.fill_null(batch.column(x), 0).to_numpy().view(np.uint64) for x in ("doc_id", "text_key"))
            drawn = mixed(mixed(ids + mixed(keys))[text] + number.astype(np.uint64))
            size = np.diff(begin, append=len(hashes))
            row, sign = (drawn & np.uint64(SKETCHED - 1)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1).astype(np.int32)
            np.add.at(sketch, places * SKETCHED + np.repeat(row, size), np.repeat(sign, size))
        for first, values, n in ((0, total, _ROWS), (_FREQUENCIES, sketch, _OF_PLACES * SKETCHED)):
            for k, x in enumerate(values.reshape(-1, n)):
                yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "values"])

    summed = _summed(docs.select("doc_id", "text", "text_key").coalesce(tasks).mapInArrow(count, "block int, values binary"))
    found = np.zeros(_FREQUENCIES * _ROWS)
    for block, x in summed.filter(F.col("block") < _FREQUENCIES).toLocalIterator():
        found[block * _ROWS : (block + 1) * _ROWS] = np.frombuffer(x, np.int64)
    return found, summed.filter(F.col("block") >= _FREQUENCIES).select((F.col("block") - _FREQUENCIES).alias("block"), "values")


def weights(found: np.ndarray) -> np.ndarray:
    return np.log((1 + found[-1]) / (1 + found[:PLACES])).astype(np.float32)


def _cut(starts: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of words: where each begins, its text, and its number there."""
    n = -(-np.diff(starts) // size)
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return starts[:-1][text] + number * size, text, number


def _block_sums(hashes: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, text, number = _cut(starts)
    if not len(begin):
        return np.zeros((0, table.shape[1]), np.float32), text, number
    # Word by word of all blocks at once; a block that has ended adds nothing.
    end, places = np.minimum(begin + BLOCK, starts[1:][text]), _places(hashes)
    total, row = table[places[begin]], np.empty((len(begin), table.shape[1]), np.float32)
    places = np.append(places, np.zeros(BLOCK, np.int64))
    for k in range(1, BLOCK):
        np.take(table, places[begin + k], axis=0, out=row, mode="clip")
        over = np.flatnonzero(begin + k >= end)
        row[over] = 0
        total += row
    return total, text, number


def _windows(sums: np.ndarray, text: np.ndarray, number: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of windows of ``blocks`` blocks, and each one's first block. A shorter text is one window. The last column holds
    the square of the length before the projection, by which vectors are divided: what a window has outside of the latent
    space makes it less alike."""
    n = len(sums)
    until = np.minimum(np.arange(n) + blocks, np.searchsorted(text, text, side="right"))
    first = np.flatnonzero((number == 0) | (until - np.arange(n) == blocks))
    total = sums.copy()
    for k in range(1, blocks):
        total[: n - k] += np.where((text[k:] == text[: n - k])[:, None], sums[k:], 0)
    total = total[first]
    return total[:, :-1] / np.sqrt(np.maximum(1e-9, total[:, -1:])), first


def _unit_row(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A passage's TF-IDF vector of length 1: its places and values."""
    place, n = np.unique(places, return_counts=True)
    value = n * idf[place]
    norm = np.linalg.norm(value)
    return (place, value / norm) if norm > 0 else None


def corpus_directions(sketch: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """OVERSAMPLED x PLACES: leading right singular vectors of the TF-IDF matrix of all passages, each as long as its singular value;
    and the squared length of that matrix. Tasks multiply the sketch's blocks; matrices of fixed size come to the driver."""
    sketch = sketch.coalesce(_PARTS)

    def weighed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for block, x in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist(), strict=True):
            yield block, np.frombuffer(x, np.int64).reshape(-1, SKETCHED) * idf[block * _OF_PLACES : (block + 1) * _OF_PLACES, None].astype(np.float64)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCHED, SKETCHED))
        for batch in batches:
            for _, x in weighed(batch):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["values"])

    gram = sum((np.frombuffer(x, np.float64) for (x,) in sketch.mapInArrow(inner, "values binary").toLocalIterator()), np.zeros(SKETCHED**2)).reshape(SKETCHED, SKETCHED)
    values, left = np.linalg.eigh(gram)
    # What the next direction has is taken for the noise that passages of one row make for each other.
    noise, values, left = max(0.0, values[-OVERSAMPLED - 1]), values[-OVERSAMPLED:], left[:, -OVERSAMPLED:]
    left = left * np.sqrt(np.maximum(0, values - noise) / np.maximum(1e-9, values))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in weighed(batch):
                made = (x @ left).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([made], pa.binary())], ["block", "values"])

    out = np.zeros((OVERSAMPLED, PLACES), np.float32)
    for block, x in sketch.mapInArrow(project, "block int, values binary").toLocalIterator():
        out[:, block * _OF_PLACES : (block + 1) * _OF_PLACES] = np.frombuffer(x, np.float32).reshape(-1, OVERSAMPLED).T
    return out, float(np.trace(gram))


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), PLACES), np.float32)
    for k, (place, value) in enumerate(rows):
        out[k, place] = value
    return out


def singular_vectors(corpus: np.ndarray, squared: float, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PLACES x RANK: right singular vectors of the corpus' directions and the items (unit rows), which weigh as much together as
    all passages (their squared length); and the share of each item's length that they keep."""
    both = np.vstack([corpus, items * np.float32(np.sqrt(max(1.0, squared / max(1, len(items)))))])
    values, left = np.linalg.eigh((both @ both.T).astype(np.float64))
    top = np.argsort(-values)[:RANK]
    top = top[values[top] > 1e-6 * max(1e-9, values[top[0]])]
    vectors = np.zeros((PLACES, RANK), np.float32)
    vectors[:, : len(top)] = both.T @ (left[:, top] / np.sqrt(values[top])).astype(np.float32)
    return vectors, np.linalg.norm(items @ vectors, axis=1)


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks: for each word of the item, the bits of its places."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_words(text: str) -> int:
    """How many words the item's last sentence has; of a single sentence, its last quarter is the answer."""
    parts = [x for x in re.split(r"(?<=[.?!:])\s+|\n", text.strip()) if x.strip()]
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return len(re.findall(r"[^\x20\x09-\x0D]+", parts[-1])) if len(parts) > 1 else -(-n // 4)


class Items:
    """A block of benchmark items: vectors, word masks, and the part of the gate that holds for each."""

    def __init__(self, rows: list[tuple[int, str]], table: np.ndarray, kept: np.ndarray):
        self.gates = np.minimum(1, kept / KEPT).astype(np.float32)
        self.ids = [i for i, _ in rows]
        hashes, starts = _words(pa.array([t for _, t in rows], pa.string()))
        self.words = [hashes[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.masks = [masks_of(w) for w in self.words]
        self.n = np.diff(starts)
        self.counts = np.zeros((len(rows), _BUCKETS), np.int32)
        np.add.at(self.counts, (np.repeat(np.arange(len(rows)), self.n), _places(hashes) % _BUCKETS), 1)
        tail = [w[-answer_words(t) :] for w, (_, t) in zip(self.words, rows, strict=True)]
        self.answers = [(masks_of(w), len(w)) for w in tail]
        total = np.array([table[_places(hashes[a:b]), :-1].sum(0) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.float32).reshape(len(rows), table.shape[1] - 1)
        self.vectors = total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True))


def _can_hold(items: Items, item: np.ndarray, buckets: np.ndarray, begin: np.ndarray, end: np.ndarray, share: float) -> np.ndarray:
    """Which of the ranges of words (their ``buckets``) have enough words in common with their item for a common subsequence of ``share``
    of it: no subsequence is longer than the words that both have, each as often as the one has it that has it less."""
    if not len(item):
        return item
    width, out = int((end - begin).max()), []
    for at in range(0, len(item), max(1, _TOGETHER // width)):
        i, a, b = (x[at : at + max(1, _TOGETHER // width)] for x in (item, begin, end))
        place = a[:, None] + np.arange(width)
        own = buckets[np.minimum(place, len(buckets) - 1)]
        n = ((items.counts[i[:, None], own] > 0) & (place < b[:, None])).sum(1)
        out.append(at + np.flatnonzero(n / items.n[i] >= share))
    found = np.concatenate(out)
    both = [np.minimum(np.bincount(buckets[a:b], minlength=_BUCKETS), items.counts[i]).sum() for i, a, b in zip(item[found], begin[found], end[found], strict=True)]
    return found[np.array(both, np.int64) / items.n[item[found]] >= share]


RESULT = "doc_id long, item_id long, text_key long, first_word int, cosine double, lcs double, answer boolean"


def _search(made: list[tuple[np.ndarray, Items]], cosine: float, lcs: float, with_answer: float) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            hashes, starts = _words(batch.column("text"))
            buckets = _places(hashes) % _BUCKETS
            best: dict[tuple[int, int, int], tuple] = {}
            for m, (table, items) in enumerate(made):
                sums, text, number = _block_sums(hashes, starts, table)
                for blocks in (BLOCKS,) if len(sums) else ():
                    vectors, first = _windows(sums, text, number, blocks)
                    for at in range(0, len(vectors), 4096):
                        near = vectors[at : at + 4096] @ items.vectors.T
                        w, i = divmod(np.flatnonzero(near >= cosine * np.maximum(items.gates, np.float32(1e-3))), near.shape[1])
                        block = first[at + w]
                        doc, n = text[block], items.n[i]
                        begin = starts[doc] + number[block] * BLOCK
                        # The window and as much around it as the item is long, so that no part of the item is cut off.
                        a, b = np.maximum(starts[doc], begin - n), np.minimum(starts[doc + 1], begin + BLOCK * blocks + n)
                        can = _can_hold(items, i, buckets, a, b, with_answer)
                        for w, i, doc, begin, n, a, b in zip(*(x[can].tolist() for x in (w, i, doc, begin, n, a, b)), strict=True):
                            words = hashes[a:b].tolist()
                            share = lcs_length(items.masks[i], n, words) / n
                            if share < with_answer:
                                continue
                            masks, size = items.answers[i]
                            answer = lcs_length(masks, size, words) >= 0.8 * size
                            if share >= lcs or answer:
                                found = (share, begin - int(starts[doc]), float(near[w, i]), answer)
                                best[doc, m, i] = max(best.get((doc, m, i), found), found)
            docs, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            rows = [(docs[d], made[m][1].ids[i], keys[d], x[1], x[2], x[0], x[3]) for (d, m, i), x in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return search


def hash_order(text: str) -> int:
    """Deals items to models alike in every run."""
    return zlib.crc32(text.encode())


def models(rows: list[tuple[int, str]], idf: np.ndarray, corpus: np.ndarray, squared: float, most: int) -> list[tuple[np.ndarray, Items]]:
    """Models and their items, ``most`` at most each. Items of which a model keeps too little are dealt to smaller ones."""
    if not rows:
        return []
    out, again, n = [], [], -(-len(rows) // most)
    for k in range(n):
        own = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        hashes, starts = _words(pa.array([t for _, t in own], pa.string()))
        units = [_unit_row(_places(hashes[a:b]), idf) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        vectors, kept = singular_vectors(corpus, squared, _dense([(np.zeros(0, int), np.zeros(0)) if x is None else x for x in units]))
        # An item without any weight (its words are in all documents) is kept by no model.
        low = [i for i, x in enumerate(units) if x is not None and kept[i] < LEAST] if len(own) > FEWEST else []
        again += [own[i] for i in low]
        stay = np.setdiff1d(np.arange(len(own)), low)
        if len(stay):
            table = np.hstack([idf[:, None] * vectors, idf[:, None] ** 2]).astype(np.float32)
            out.append((table, Items([own[i] for i in stay], table, kept[stay])))
    return out + models(again, idf, corpus, squared, max(FEWEST, most // 2))


def leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, with_answer: float = LCS_WITH_ANSWER,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """One row for each document (doc_id, text) and benchmark item (item_id, text) that it holds: RESULT.

    lcs: the item's share that is found in its order; answer: whether its last sentence is among that. Null and empty texts on
    either side are never found; repeated rows are found each; a null id stays null; empty tables give no rows; other columns
    are not read.
    """
    prepare(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found, sketch = counts(given)
    idf = weights(found)
    wanted = benchmark.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-wanted.count() // (items_at_once * MODELS)))
    corpus, squared = corpus_directions(sketch, idf)
    out = None
    for k in range(passes):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        rows = sorted((tuple(r) for r in rows), key=lambda r: (hash_order(r[1]), r[1], r[0] is None, r[0]))
        made = models(rows, idf, corpus, squared, items_at_once)
        for at in range(0, max(1, len(made)), MODELS):
            shared = docs.sparkSession.sparkContext.broadcast(made[at : at + MODELS])

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                yield from _search(shared.value, cosine, lcs, with_answer)(batches)

            part = given.select("doc_id", "text", "text_key").mapInArrow(search, RESULT)
            out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which nothing was found, all columns as they were."""
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left_anti")
