import random
import tracemalloc
from collections import Counter

import numpy as np

from talewind.llm import radix
from talewind.llm.common import anchors


def brute(rows, window=200):
    """rows: (doc_id, text), each a document of its own."""
    seen = Counter()
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, b in data:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for doc, b in data:
        gone, until = bytearray(len(b)), 0
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                for j in range(max(i, until), i + window):
                    gone[j] = 1
                until = i + window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), runs, kept))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()), key=repr)


def messy(seed=3):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages, rows = [text(rng.randrange(150, 700)) for _ in range(8)], []
    for i in range(60):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            part = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(part) + 1), 2)) if rng.random() < 0.5 else (0, len(part))
            part = part[a:b]
            if part and rng.random() < 0.6:
                at = rng.randrange(len(part))
                part = part[:at] + "X" + part[at + 1 :]
            parts += [part, text(rng.randrange(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 199), (101, "a" * 200), (102, "b" * 201), (103, "ab" * 300), (104, None), (105, ""), (106, passages[0] * 2), (107, "ab" * 120 + "c" * 90)]
    return rows


def test_against_brute_force(spark, documents):
    rows = messy()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(radix.without_repeats(frame)) == brute(rows)
    sample = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    frame = spark.createDataFrame(sample, "doc_id long, text string")
    assert got(radix.without_repeats(frame)) == brute(sample)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(5, "y" * 150 + "z" * 150), (5, "y" * 150 + "z" * 150), (None, "q" * 90 + "r" * 130), (8, "q" * 90 + "r" * 130)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(radix.without_repeats(frame)) == brute(rows)
    assert radix.without_repeats(odd.limit(0)).count() == 0


def test_runs_of_one_byte(spark):
    rows = [(1, "=" * 2500), (2, "x" + "=" * 900 + "y"), (3, "=" * 150), (4, "-" * 700 + "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(radix.without_repeats(frame)) == brute(rows)
    values = np.full(200_000, 7, np.uint64)
    tracemalloc.start()
    at, _, lo, hi = anchors(values, np.array([0, len(values)]), 200, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == len(values) - 199 and not lo.any() and not hi.any() and peak < 150 << 20
