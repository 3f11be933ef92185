"""Exact Jaccard similarity join on word shingles by prefixes under several global token orders.

Texts with the same shingle set are one node. A node's prefix under an order is its least n - ceil(t n) + 1 shingles; two sets
of similarity t or more share a shingle in their prefixes under every order. The first order (rare shingles first) finds
candidates; two more orders tell from their prefixes how large the intersection can be at most, and a pair must pass both before
its whole sets are compared. Rarity comes from counters over all documents; it orders shingles and decides nothing else.

Large groups never yield all their pairs: each member is first compared with one pivot of each shingle's group, which joins
copies to components; then only pairs of different components are left, and they are all compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talewind.llm.common import components, filled, mixed, prepare, repeated_keys, rolling, slices, split_words, word_hashes
from talewind.session import cut_lineage

SHINGLE, PERCENT = 5, 75
#: The rarity sketch has some PER_DOC counters for each document, but not more than MOST (a byte each for the tasks). Its size
#: decides how well frequent shingles are told from rare ones, never which links are found.
PER_DOC, MOST, BLOCK = 16, 1 << 24, 1 << 12
#: Two rounds of deals into groups of frequent shingles: seeds, and how many nodes have such a shingle; pivots a group.
DEALS, PIVOTS = ((range(1), 4), (range(2, 6), 32)), 8
_SECOND, _THIRD, _FOURTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: 256 bits of a set: whether an even or odd number of its shingles falls on each place.
PARITY = ("p0", "p1", "p2", "p3")


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's shingles as sorted distinct 64-bit hashes."""
    codes, starts, words = split_words(pc.ascii_lower(filled(texts)))
    values = word_hashes(words)[codes]
    hashes, out = rolling(values, size), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            # Fewer words: the whole sequence is one shingle, told apart by its length.
            out.append(mixed(rolling(values[a:b], b - a) + np.uint64(b - a)) if b > a else values[:0])
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _heads(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, set_key for each row, and how frequent shingles are over all rows: grades (twice the logarithm of a counter)."""

    size_of_sketch = min(MOST, 1 << max(12, (PER_DOC * docs.count() - 1).bit_length()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size_of_sketch, np.uint32)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            if sets:
                np.add.at(counters, np.concatenate(sets) & np.uint64(size_of_sketch - 1), 1)
            n = pa.array([len(x) for x in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, pa.array([_key(x) for x in sets], pa.binary()), none], ["doc_id", "n", "key", "block"]
            )
        blocks = [x.tobytes() for x in counters.reshape(-1, BLOCK)]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array(blocks, pa.binary()), pa.array(range(len(blocks)), pa.int32())], ["doc_id", "n", "key", "block"]
        )

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for x in table.column("key"):
            total += np.frombuffer(x.as_py(), np.uint32)
        grade = np.minimum(63, np.log2(total.astype(np.float64) + 1) * 2).astype(np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "total": pa.array([grade.tobytes()], pa.binary())})

    rows = cut_lineage(docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, key binary, block int"))
    # A byte for each counter comes to the driver and goes to the tasks.
    blocks = rows.filter("block is not null").groupBy("block").applyInArrow(lambda table: summed(table), "block int, total binary").collect()
    counters = np.zeros(size_of_sketch, np.uint8)
    for block, total in blocks:
        counters[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(total, np.uint8)
    return rows.filter("block is null").select("doc_id", "n", F.col("key").alias("set_key")), counters


def _of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text and set_key of one row for each node; nodes: doc_id, set_key."""
    texts = docs.select("doc_id", "text").join(nodes, "doc_id")
    return texts.withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"]).select("doc_id", "text", "set_key")


def _signatures(texts: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """node, n, first (the prefix under the first order), second and third (order values of those prefixes, 32 bits, sorted), parity."""
    shared = texts.sparkSession.sparkContext.broadcast(counters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in slices(batches):
            rows = tuple([] for _ in range(9))
            for doc, key, own in zip(batch.column("doc_id").to_pylist(), batch.column("set_key").to_pylist(), shingle_sets(batch.column("text"), size), strict=True):
                if not len(own) or _key(own) != key:
                    continue
                k, low = prefix_size(len(own), percent), rare[own & np.uint64(len(rare) - 1)].astype(np.uint64) << np.uint64(58)
                first = own[np.argsort(low | (own >> np.uint64(6)), kind="stable")[:k]]
                second = np.sort(low | (mixed(own * _SECOND) >> np.uint64(6)))[:k]
                third = np.sort(mixed(own * _THIRD))[:k]
                made = (doc, len(own), first.view(np.int64), *((x >> np.uint64(32)).astype("<u4").tobytes() for x in (second, third)), *_parity(own))
                for to, x in zip(rows, made, strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["node", "n", "first", "second", "third", *PARITY])

    kinds = ", ".join(f"{p} long" for p in PARITY)
    return cut_lineage(texts.mapInArrow(read, f"node long, n long, first array<long>, second binary, third binary, {kinds}"))


def _parity(own: np.ndarray) -> list[int]:
    odd = np.bincount((mixed(own * _FOURTH) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _may_be_alike(n: str, m: str, percent: int):
    """Whether sets of n and m shingles with parities p0.. and q0.. can be similar enough: of two that are, at most
    (n + m) (1 - t) / (1 + t) shingles are in one alone, and a place whose parities differ has at least one of those."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p[1:]}"))) for p in PARITY), F.lit(0))
    return differ * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def _reach(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """The most common shingles that two sets can have, given the least order values of both."""
    end = min(a[-1], b[-1])
    # Below ``end`` all values of both sets are known.
    a, b = a[: np.searchsorted(a, end)], b[: np.searchsorted(b, end)]
    # Equal values of different shingles (they are cut to 32 bits) may hide a common one, so each counts as one.
    hidden = np.count_nonzero(a[1:] == a[:-1]) + np.count_nonzero(b[1:] == b[:-1])
    return len(np.intersect1d(a, b)) + hidden + min(n_a - len(a), n_b - len(b))


def similar_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _may_link(n: str, i: str, m: str, j: str, percent: int):
    """Whether sets of n and m shingles that meet at places i and j (from 0) of their orders can still be similar enough, if none
    of the shingles before is common: at most the rest of the smaller one is."""
    rest = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return similar_size(n, m, percent) & (rest * (100 + percent) >= (F.col(n) + F.col(m)) * percent)


def _early(n: str, i: str, percent: int):
    """Whether place i of n is early. If two sets that may link meet first at places i and j, the shingles after are enough for both, so
    i + j <= (n + m) (1 - t) / (1 + t), and one of the two is at most half of that; with m <= n / t it is at most n (1 - t) / 2 t."""
    return F.col(i) * 2 * percent <= F.col(n) * (100 - percent)


def _met(few: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Candidates a, b of different groups, few (x, m, j, g, q0..) against rest (node, n, i, group, main, p0..), by a shingle that may be
    their first common one. Sizes are dealt to classes of ratio t, so that only texts of similar size come together."""
    ratio = math.log(100 / percent)
    size_class = lambda c: F.floor(F.log(F.col(c).cast("double")) / ratio).cast("int")
    few = few.withColumn("early_x", _early("m", "j", percent)).withColumn("c", F.explode(F.array(*(size_class("m") + k for k in (-1, 0, 1)))))
    rest = rest.withColumn("early", _early("n", "i", percent)).withColumn("c", size_class("n"))
    # Both orders of a pair meet where neither is of the main group; one is enough.
    once = (F.col("group") == F.col("main")) | (F.col("x") < F.col("node"))
    apart = (F.col("g") != F.col("group")) & once & _may_link("n", "i", "m", "j", percent) & _may_be_alike("n", "m", percent)
    met = [few.filter(a).join(rest.filter(b), ["token", "c"]).filter(apart).select(*_pair("x", "node")) for a, b in (("early_x", "true"), ("not early_x", "early"))]
    return met[0].union(met[1])


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose sets are similar enough: a, b."""
    side = lambda c: signatures.select(*(F.col(x).alias(f"{c}_{x}") for x in ("n", "second", "third")), F.col("node").alias(c))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, a2, b2, a3, b3 in zip(*(batch.column(f"{c}_{x}").to_pylist() for x in ("n", "second", "third") for c in "ab"), strict=True):
                least = min(_reach(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), n_a, n_b) for x, y in ((a2, b2), (a3, b3)))
                keep.append(100 * least >= percent * (n_a + n_b - least))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select(["a", "b"])

    left = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bounded, "a long, b long"))
    wanted = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = shingle_sets(batch.column("text"), size)
            right = pa.array([_key(x) == k for x, k in zip(own, batch.column("set_key").to_pylist(), strict=True)], pa.bool_())
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "own"])
            yield rows.filter(right)

    whole = cut_lineage(_of_nodes(docs, nodes.join(wanted, "doc_id")).mapInArrow(sets, "node long, own binary"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a").to_pylist(), batch.column("own_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    of = lambda c: whole.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    return cut_lineage(left.join(of("a"), "a").join(of("b"), "b").mapInArrow(compared, "a long, b long"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _dealt(postings: DataFrame, seeds: range, frequent: int, percent: int) -> DataFrame:
    """Candidates: for each seed, each node goes to the group of one of its frequent shingles and meets the group's pivots."""
    out = None
    for seed in seeds:
        least = postings.filter(F.col("_n") >= frequent).groupBy("node", "n").agg(F.min(F.struct(F.xxhash64("token", F.lit(seed)).alias("h"), "token")).alias("t"))
        dealt = cut_lineage(least.select("node", "n", "t.token", F.xxhash64("node", F.lit(seed)).alias("h")))
        some = dealt.groupBy("token", F.pmod("h", F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct("h", F.col("node").alias("pivot"), F.col("n").alias("m"))).alias("p"))
        some = cut_lineage(some.select("token", "p.pivot", "p.m"))
        pairs = dealt.join(some, "token").filter((F.col("node") != F.col("pivot")) & similar_size("n", "m", percent)).select(*_pair("node", "pivot"))
        out = pairs if out is None else out.union(pairs)
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable by links, a row's own if it has none. Texts without words (null, empty) have
    no shingles and no links. Rows with one doc_id are one node; a row with a null doc_id takes part in nothing and has a null
    component. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads, counters = _heads(docs, size)
    alike = heads.filter("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    nodes = cut_lineage(alike.select("doc_id", "set_key"))
    signatures = _signatures(_of_nodes(docs, nodes), counters, size, percent)
    every = signatures.select(F.posexplode("first").alias("i", "token"), "node", "n")
    postings = cut_lineage(every.join(repeated_keys(every, "token"), "token"))

    # First each member of a shingle's group against the group's pivot, and against pivots of some frequent shingles' groups.
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("i").alias("j"))).alias("p")
    pivots = cut_lineage(postings.groupBy("token").agg(lead).select("token", "p.pivot", "p.m", "p.j"))
    star = postings.join(pivots, "token").filter((F.col("node") != F.col("pivot")) & _may_link("n", "i", "m", "j", percent)).select(*_pair("node", "pivot"))
    tried = cut_lineage(star.union(_dealt(postings, *DEALS[0], percent)).distinct())
    links = _verified(tried, signatures, docs, nodes, size, percent)
    found = cut_lineage(components(links).withColumnRenamed("component", "group"))

    # Again with other pivots, for what isn't joined yet.
    more = _dealt(postings, *DEALS[1], percent).distinct()
    of = lambda c: found.select(F.col("node").alias(c), F.col("group").alias(f"g_{c}"))
    apart = F.coalesce("g_a", "a") != F.coalesce("g_b", "b")
    more = cut_lineage(more.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(apart).select("a", "b").join(tried, ["a", "b"], "left_anti"))
    links = cut_lineage(links.union(_verified(more, signatures, docs, nodes, size, percent)))
    tried = tried.union(more)

    # Then all pairs that the components so far leave open.
    found = components(links).withColumnRenamed("component", "group")
    of_node = signatures.select("node", *PARITY).join(found, "node", "left").withColumn("group", F.coalesce("group", "node"))
    grouped = cut_lineage(postings.drop("_n").join(of_node, "node"))
    per = cut_lineage(grouped.groupBy("token", "group").agg(F.count("*").alias("k")))
    most = per.groupBy("token").agg(F.max(F.struct("k", "group")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    open_ = cut_lineage(most.select("token", F.col("top.group").alias("main")))
    rest = cut_lineage(grouped.join(open_, "token"))
    few = rest.filter("group <> main").select("token", F.col("node").alias("x"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("group").alias("g"), *(F.col(p).alias(f"q{p[1:]}") for p in PARITY))
    # A pair may link by the first shingle both have, and there one of the two is early (see _early); so only early ones look for partners.
    met = _met(few, rest, percent)
    pairs = cut_lineage(met.distinct().join(tried, ["a", "b"], "left_anti"))
    links = links.union(_verified(pairs, signatures, docs, nodes, size, percent))

    joined = components(links).withColumnRenamed("node", "doc_id")
    named = cut_lineage(nodes.join(joined, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("least")))
    # Ids that stand for several texts link these: their components are one.
    shared = heads.filter("n > 0 and doc_id is not null").select("doc_id", "set_key").distinct()
    several = shared.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if not several.isEmpty():
        linked = shared.join(several, "doc_id").join(named, "set_key").select("doc_id", "least")
        more = components(linked, "doc_id", "least").select(F.col("node").alias("least"), "component")
        named = cut_lineage(named.join(more, "least", "left").select("set_key", F.coalesce("component", "least").alias("least")))
    rows = heads.join(named, "set_key", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they were, without those that are linked to a smaller id; of rows with one id, one. Rows
    with a null id stay."""
    found = cut_lineage(found)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_doc")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == F.col("_doc"), "left_anti")
    if found.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    empty = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.filter(~empty).dropDuplicates(["doc_id"]).unionByName(left.filter(empty))
