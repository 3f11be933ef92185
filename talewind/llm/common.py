"""What the text operators share: Arrow slices of bounded size, words as numbers, repeated keys, links to components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talewind.session import cut_lineage

#: Bytes of text that one step of a Python task looks at; a single longer text is one step of its own.
SLICE_BYTES = 2 << 20
#: Anchors that are looked at together; each takes some KB.
ANCHOR_ROWS = 1 << 13
#: Words are runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, as texts differ much in length, and let Spark delete a job's shuffle files when the
    job has ended: every step below ends in a written table, so nothing reads them again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``most`` bytes (at least one row each)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more than there are texts)."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts: a code per word, where each text begins, and the words that the codes stand for."""
    lists = pc.ascii_split_whitespace(filled(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.flatten()
    coded = values.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    there = (pc.binary_length(words).to_numpy() > 0)[codes] if len(words) else np.zeros(0, bool)
    until = np.concatenate([[0], np.cumsum(there)])
    return codes[there], until[offsets - offsets[0]], words


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, the same in every task."""
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class RangeHashes:
    """Hashes of ranges of a sequence of 64-bit numbers: differences of prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, odd: np.uint64 = _ODD):
        n = len(values)
        powers, self.back = np.full(n + 1, odd), np.full(n + 1, np.uint64(_inverse(int(odd))))
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    def __call__(self, begin, end) -> np.ndarray:
        """begin, end: arrays of places, or slices of all places."""
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + _ODD)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """For each i, a hash of values[i : i + k] (64-bit numbers)."""
    n = len(values)
    return RangeHashes(values)(slice(0, n - k + 1), slice(k, n + 1)) if n >= k else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f (minimum or maximum) over values[i : i + w] for each i, from accumulations to both sides within blocks of w."""
    n = len(values)
    if w == 1 or n < w:
        return values[: max(0, n - w + 1)]
    padded = np.concatenate([values, np.full(-n % w, values[-1], values.dtype)]).reshape(-1, w)
    ahead = f.accumulate(padded, axis=1).ravel()
    behind = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(values: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-chosen positions of a sequence that consists of texts, such that each window has one and equal windows have it at
    the same place.

    A window of ``window`` values within one text is owned by the first of its grams of ``gram`` values with the least hash.
    Returns positions of such grams, their hashes, and the least and greatest distance from an owned window's start (these
    distances are contiguous).
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    span = window - gram + 1
    if len(values) < window:
        return none
    hashes = rolling(values, gram)
    least = sliding(hashes, span, np.minimum)
    lengths = np.diff(starts)
    change = np.zeros(len(least) + 1, np.int32)
    long = lengths >= window
    np.add.at(change, starts[:-1][long], 1)
    np.add.at(change, starts[1:][long] - window + 1, -1)
    good = np.cumsum(change[:-1]) > 0
    edge = np.zeros(span - 1, np.uint64)
    # The greatest of the minima of the good windows that hold a gram equals its hash if some window chose it.
    best = sliding(np.concatenate([edge, np.where(good, least, np.uint64(0)), edge]), span, np.maximum)
    at = np.flatnonzero((best == hashes) & (hashes > 0))
    if not len(at):
        return none
    # In pieces: each has tables of positions and distances, and in a run of one value every position is an anchor.
    parts = [_owned(at[i : i + ANCHOR_ROWS], hashes, least, good, span) for i in range(0, len(at), ANCHOR_ROWS)]
    owner, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = at[owner]
    return at, hashes[at], lo[owner], hi[owner]


def _owned(at: np.ndarray, hashes: np.ndarray, least: np.ndarray, good: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each gram at ``at``: whether it owns a window, and the least and greatest distance from an owned window's start."""
    back = at[:, None] - np.arange(span)[None, :]
    inside = (back >= 0) & (back < len(least))
    back = np.clip(back, 0, len(least) - 1)
    own = hashes[at][:, None]
    chose = inside & good[back] & (least[back] == own)
    # No equal gram before it in the window.
    before = (hashes[np.maximum(at[:, None] - np.arange(1, span)[None, :], 0)] == own) & (np.arange(1, span)[None, :] <= at[:, None])
    chose[:, 1:] &= np.cumsum(before, axis=1) == 0
    return chose.any(axis=1), chose.argmax(1), span - 1 - chose[:, ::-1].argmax(1)


def repeated_keys(rows: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """The keys that occur twice or more, and how often (_n), as a written table (rows are combined before the shuffle; joins to the table can be
    split by Spark where a key is hot). n: a column of weights, 1 if not given."""
    count = F.count("*") if n is None else F.sum(n)
    return cut_lineage(rows.groupBy(key).agg(count.alias("_n")).filter("_n > 1"))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node -> component (its smallest node) for every node of ``links``.

    Each round hooks a group to the neighbour of least hash and contracts the links, so their number falls by a random
    factor; a chain takes rounds as the logarithm of its length. Hubs are met in joins that Spark can split.
    """
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b))).distinct()
    labels = cut_lineage(nodes.withColumn("root", F.col("node")))
    edges = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels.join(labels.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
        both = edges.union(edges.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hooked = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["id"].alias("to"))
        hooked = cut_lineage(hooked)
        of_v = hooked.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        moved = edges.join(hooked, "u").join(of_v, "v").select(F.least("to", "to_v").alias("u"), F.greatest("to", "to_v").alias("v"))
        edges = cut_lineage(moved.filter("u <> v").distinct())
        to = hooked.select(F.col("u").alias("root"), "to")
        labels = cut_lineage(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of (doc_id, text) under unique ids in the order of doc_id, and what the ids stand for.

    Where doc_ids are unique and not null they serve as they are (None). Else rows of one id and text are one document, whose number
    comes from a sort by id (null first) and text; the second frame has doc_id, text_key, number and how often the rows come.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if ids.isEmpty():
        return docs, None
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    every = keyed.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    # Sorted parts are numbered one after the other; written, so that the numbers stay.
    named = cut_lineage(every.orderBy("doc_id", "text_key").withColumn("number", F.monotonically_increasing_id()))
    to = named.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "number")
    met = keyed.join(to, keyed["doc_id"].eqNullSafe(F.col("_doc")) & (keyed["text_key"] == F.col("_key")))
    return cut_lineage(met.select(F.col("number").alias("doc_id"), "text").dropDuplicates(["doc_id"])), named


def back_to_rows(made: DataFrame, named: DataFrame | None) -> DataFrame:
    """One row for each row given to in_order(), under its doc_id."""
    if named is None:
        return made
    rows = named.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return made.withColumnRenamed("doc_id", "number").join(rows.select("number", "doc_id"), "number").drop("number")


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges cover; touching ones are one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])[: len(begin)])
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(begin) else end
