import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from talewind.llm import trie


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text) -> the nodes, by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] += (len(members[node]) - 1) * words
        leaves[node] += not children[node]
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if len(made[c]) == len(node))
        above = members[node[:-1]][0] if node else None
        out.append((of[0], len(node), above, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def messy(n=150, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(n):
        length = rng.choice((0, 1, 2, 3, 5, 5, 8, 40)) if c % 5 else 4
        for turn in range(length):
            text = rng.choice(("", "a", "a b", "hello  there\tyou", None)) if turn < 6 or c % 3 else f"own {c} {turn}"
            rows.append((c, None if turn == 1 and c % 7 == 0 else turn, rng.choice(("user", "user", "user", None)), text))
    # A group of equal conversations, one that is a prefix of it, ties, a null id, negative ids.
    for c in range(1000, 1080):
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    rows += [(2000, t, "user", f"same {t}") for t in range(3)] + [(2001, 1, "b", "y"), (2001, 1, "a", "z"), (2001, 1, "a", "x"), (2001, None, "q", None)]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "minus"), (-7, 1, "user", "minus"), (-40, 0, "user", "minus"), (-45, 3, "a", "b")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, sf):
    rows = messy()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = brute(rows)
    assert got(trie.trie(frame)) == want
    # Many shards: nodes go over borders, at several levels.
    assert got(trie.trie(frame, cells=40, fan=3)) == want
    assert got(trie.trie(frame, cells=15, fan=2, rebuild=False)) == brute(rows, rebuild=False)
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(trie.trie(given)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in given.collect()])


def test_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string, place long, words string, n int"
    assert trie.trie(spark.createDataFrame([], kinds)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 1)], kinds)).count() == 0
    rows = [(5, 0, "user", "w " * 500_000, 1, "x", 1), (5, 0, "user", "w " * 500_000, 1, "x", 1), (6, None, None, None, 2, "y", 2)]
    rows += [(7, t, "user", "t", 0, None, None) for t in range(3000)]
    assert got(trie.trie(spark.createDataFrame(rows, kinds))) == brute([r[:4] for r in rows])


def test_conversations_over_ranges_are_numbered(spark):
    """One conversation with nearly all turns lies in several ranges."""
    rows = [(1, t, "u", str(t)) for t in range(400)] + [(2, 0, "u", "x"), (0, 5, "u", "y")]
    random.Random(2).shuffle(rows)
    placed = trie.in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert sorted((r.conv_id, r.place) for r in placed.collect()) == sorted([(1, t) for t in range(400)] + [(2, 0), (0, 0)])
    ids = {r.place: r.hi for r in placed.filter("conv_id = 1").collect()}
    want = spark.range(400).select("id", F.xxhash64(F.lit("u"), F.col("id").cast("string")).alias("h")).collect()
    assert ids == {r.id: r.h for r in want}


def test_marks_start_nodes():
    rng = np.random.default_rng(3)
    rows = {tuple(rng.integers(0, 3, rng.integers(0, 40)).tolist()) for _ in range(200)} | {(1,) * k for k in (0, 15, 16, 17, 32, 33, 35, 48)}
    rows = list(rows)
    flat = np.array([x for r in rows for x in r], np.int64)
    made = trie.Rows(np.array([len(r) for r in rows]), flat, flat * 0, flat, {}, [])
    order, start = made.sort()
    assert [rows[i] for i in order] == sorted(rows)
    seen, want = set(), []
    for r in sorted(rows):
        for d in range(len(r) + 1):
            want.append(r[:d] not in seen)
            seen.add(r[:d])
    assert start.tolist() == want
