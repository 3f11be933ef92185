import random
import re

import numpy as np

from talewind.llm import automata
from talewind.llm.common import anchors, merged


def brute(rows, window=20):
    """rows: (doc_id, text), unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def got(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in frame.collect()}


def messy(seed=1):
    rng, rows = random.Random(seed), []
    passages = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    for i in range(70):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            part = list(rng.choice(passages))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edit"
            words += part + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(words)))
    rows += [(100, "a b c " * 40), (101, "z " * 90), (102, "a b c " * 20 + "z " * 30), (103, " ".join(passages[0] * 3)), (104, None), (105, " ")]
    return rows


def test_against_brute_force(spark, documents):
    rows = messy()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(automata.without_repeats(frame)) == brute(rows)
    assert got(automata.without_repeats(frame, shard=2)) == brute(rows)
    sample = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(automata.without_repeats(documents)) == brute(sample)


def test_odd_rows(spark, odd):
    rows = automata.without_repeats(odd).collect()
    assert len(rows) == 13 and {r.n_removed for r in rows if r.doc_id == 5} == {0}
    assert automata.without_repeats(odd.limit(0)).count() == 0
    long = " ".join(f"k{i}" for i in range(25))
    frame = spark.createDataFrame([(None, long), (4, long), (4, long), (4, "other"), (9, long)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in automata.without_repeats(frame).collect()) == [(-1, 0), (4, 0), (4, 25), (4, 25), (9, 25)]


def test_automaton_matches():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        automaton = automata.SuffixAutomaton()
        for k, text in enumerate(texts):
            want = [max((n for n in range(i + 2) if any(text[i + 1 - n : i + 1] == t[j : j + n] for t in texts[:k] for j in range(len(t) - n + 1))), default=0) for i in range(len(text))]
            assert automaton.matches(text) == want
            automaton.add(text)


def test_each_window_has_one_owner():
    rng = np.random.default_rng(4)
    for kinds in (2, 5, 1000):
        values = rng.integers(0, kinds, 600).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        starts = np.array([0, 0, 150, 160, 600])
        at, own, lo, hi = anchors(values, starts, 20, 6)
        owned = sorted((int(p - d)) for p, a, b in zip(at, lo, hi, strict=True) for d in range(a, b + 1))
        assert owned == [s for a, b in zip(starts[:-1], starts[1:], strict=True) for s in range(a, b - 19)]


def test_merged():
    a, b = merged(np.array([5, 1, 3, 20]), np.array([9, 3, 4, 25]))
    assert a.tolist() == [1, 5, 20] and b.tolist() == [4, 9, 25]
