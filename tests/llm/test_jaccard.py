import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from talewind.llm import jaccard
from talewind.llm.common import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """rows: (doc_id, text) with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def got(frame):
    return {tuple(r) for r in frame.collect()}


def test_sample(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(jaccard.near_duplicates(documents)) == brute(rows)


def test_edited_copies(spark):
    rng, rows = random.Random(5), []
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(60 + 30 * base)]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[rng.randrange(0, 6) :]).title()))
    line = " ".join(f"common{i}" for i in range(12))
    rows += [(1000 + i, line + " " + " ".join(f"u{i}x{j}" for j in range(i % 9))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(jaccard.near_duplicates(frame)) == brute(rows)


def test_odd_rows(spark, odd):
    result = jaccard.near_duplicates(odd).collect()
    assert len(result) == 13
    by = {r["doc_id"]: r for r in result}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[5]["component_id"] == 5 and by[None]["component_id"] is None and by[3]["n_shingles"] == 1
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "c d e"), (3, "c d e"), (9, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(twice).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_reach_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 2**32, 60, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in "ab")
        k = [np.sort(x)[: jaccard.prefix_size(len(x))] for x in (a, b)]
        assert jaccard._reach(*k, len(a), len(b)) >= len(np.intersect1d(a, b))


def test_parities_differ_little_for_similar_sets(spark):
    rng, rows = np.random.default_rng(4), []
    for n in (1, 2, 7, 40, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, len(a) // 4 + 1)], rng.integers(0, 2**63, rng.integers(0, n // 4 + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            rows.append((len(a), len(b), 100 * common >= 75 * (len(a) + len(b) - common), *jaccard._parity(a), *jaccard._parity(b)))
        c = rng.integers(0, 2**63, n, dtype=np.uint64)
        rows.append((len(a), n, None, *jaccard._parity(a), *jaccard._parity(c)))
    names = "n long, m long, alike boolean, " + ", ".join(f"{x}{k} long" for x in "pq" for k in range(4))
    told = spark.createDataFrame(rows, names).select("n", "alike", jaccard._may_be_alike("n", "m", 75).alias("may")).collect()
    assert all(r.may for r in told if r.alike) and sum(bool(r.alike) for r in told) > 40
    # Sets with nothing in common are told apart while 256 bits are enough.
    assert not any(r.may for r in told if r.alike is None and 2 < r.n <= 300)


def test_short_sequences_differ_from_shingles():
    sets = jaccard.shingle_sets(pa.array(["a b c d e", "a b c d", "A  b\tc d", None, "b a c d"]))
    assert [len(x) for x in sets] == [1, 1, 1, 0, 1]
    assert sets[1] == sets[2] and len({int(sets[i][0]) for i in (0, 1, 4)}) == 3


def test_components_of_a_chain(spark):
    links = spark.range(0, 200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901)], "a long, b long"))
    found = {r.node: r.component for r in components(links).collect()}
    assert len(found) == 203 and {found[i] for i in range(201)} == {0} and found[901] == 900
