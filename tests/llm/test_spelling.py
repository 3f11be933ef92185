import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from talewind.llm import spelling


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        out[w] = [form, n, len(others), -others[0][0] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def got(frame):
    rows = frame.collect()
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(made) == len(rows)
    return made


def messy():
    rng, rows = random.Random(3), []
    kept = ["abcdefg", "hijklmnopq", "Ôterrasse", "aaaaaaaa", "banananana", "w" * 300]
    letters = "abcdewnàÿ"
    for i in range(160):
        words = []
        for _ in range(60):
            word = list(rng.choice(kept))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(word))
                word[at : at + rng.randrange(2)] = rng.choice(("", rng.choice(letters)))
            words.append("".join(word))
        rows.append((i, rng.choice((" ", ", ", "1")).join(words)))
    # Three words, each ten times as frequent as the one before.
    rows.append((900, " ".join(["chained"] * 2 + ["chaines"] * 20 + ["chainesx"] * 200)))
    return rows + [(901, None), (902, ""), (None, "banananana " * 40), (3, rows[3][1])]


def test_against_brute_force(spark, documents):
    rows = messy()
    want = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(spelling.variants(frame)) == want
    assert got(spelling.variants(frame, parts=4)) == want
    assert sum(r[0] is not None for r in want.values()) > 20 and any(r[0] != r[1] for r in want.values())
    assert want["chained"][:2] == ("chaines", "chainesx")
    sample = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(spelling.variants(documents)) == brute(sample)


def test_odd_rows(spark, odd):
    assert {r.word: r.n for r in spelling.variants(odd).collect()} == {}
    assert spelling.variants(odd.limit(0)).count() == 0
    long = "q" * 1_000_000
    rows = [(1, f"{long} {long}x {long}"), (2, long + "1" + long + "x"), (3, "Straßen ÉCOLES École écoles straßen STRASSEN ÉCOLES")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    found = spelling.counted(frame.select("doc_id", "text"), noise=None).collect()
    assert {(len(r.word), r.n) for r in found} == {(1_000_000, 3), (1_000_001, 2), (7, 2)}


def test_signatures_meet_for_every_edit(spark):
    """All words one edit from a word share a signature with it, and no pair comes twice."""
    base = "mississippi"
    made = {base} | {base[:i] + x + base[i + d :] for i in range(len(base)) for d in (0, 1) for x in ("", "i", "q", "é")} | {base + "s"}
    frame = spark.createDataFrame([(w,) for w in made], "word string")
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(frame).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in made for b in made if a < b and near(a, b)}
