import random

import numpy as np
import pyarrow as pa

from talewind.llm import latent


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in "ab")
        assert latent.lcs_length(latent.masks_of(a), len(a), b) == lcs(a, b)


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in latent.leaks(docs, benchmark).collect()}
    items = [(r.item_id, r.text.lower()) for r in benchmark.collect()]
    true = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text.lower()}
    assert true and len(found & true) >= 0.9 * len(true) and len(found - true) <= 0.02 * 1000
    clean = latent.clean_documents(docs, latent.leaks(docs, benchmark))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()}.isdisjoint(d for d, _ in true)


def test_paraphrases_and_odd_rows(spark, odd):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(40)]
    noise = lambda n: " ".join(f"x{rng.randrange(4000)}" for _ in range(n))
    edited = [w for k, w in enumerate(words) if k % 6] + ["tail"]
    docs = spark.createDataFrame([(i, noise(200)) for i in range(60)] + [(100, noise(90) + " " + " ".join(edited) + " " + noise(90)), (101, " ".join(words))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, noise(30)), (3, None), (4, "  ")], "item_id long, text string")
    for at_once in (latent.ITEMS, 1):
        assert {(r.doc_id, r.item_id) for r in latent.leaks(docs, benchmark, items_at_once=at_once).collect()} == {(100, 1), (101, 1)}
    assert latent.leaks(odd, benchmark).count() == 0 and latent.leaks(odd.limit(0), benchmark).count() == 0
    found = latent.leaks(odd, benchmark.limit(0))
    assert found.count() == 0 and latent.clean_documents(odd, found).count() == 13


def test_recall_with_thousands_of_items(spark):
    """Items of 15 to 60 words, far more than the directions of one model: all of their verbatim copies are known by brute force."""
    rng, rows = random.Random(5), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    words = {d: t.lower().split() for d, t in rows if t and len(t.split()) >= 60}
    items, first = {}, {}
    for i in range(4000):
        own, n = words[rng.choice(sorted(words))], rng.randrange(15, 61)
        at = rng.randrange(len(own) - n + 1)
        items[i] = own[at : at + n]
        first.setdefault(tuple(items[i][:15]), []).append(i)
    true = {(d, i) for d, w in words.items() for k in range(len(w) - 14) for i in first.get(tuple(w[k : k + 15]), ()) if w[k : k + len(items[i])] == items[i]}
    docs = spark.createDataFrame([(d, t) for d, t in rows if d in words], "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in latent.leaks(docs, benchmark).collect()}
    recall = len(found & true) / len(true)
    print(f"recall {recall:.4f} of {len(true)} pairs")
    assert len(true) >= 4000 and recall >= 0.9


def test_directions_come_from_all_passages(spark):
    """Every word of every passage is in the model's sums, and its leading directions are those of an exact decomposition."""
    rng = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(150)] for k in range(5)]
    texts = [" ".join(rng.choice(topics[rng.choice((0, 0, 0, 1, 1, 2, 3, 4))]) if rng.random() < 0.1 else rng.choice(topics[d % 5]) for _ in range(30 + d % 150)) for d in range(900)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, text_key long").repartition(7)
    found, sketch = latent.counts(docs)
    idf = latent.weights(found)
    passages = [t.split()[a : a + 48] for t in texts for a in range(0, len(t.split()), 48)]
    exact = np.zeros((len(passages), latent.PLACES), np.float32)
    for k, words in enumerate(passages):
        np.add.at(exact[k], latent._places(latent._words(pa.array([" ".join(words)]))[0]), 1)
    assert found[-1] == 900
    rows = np.vstack([np.frombuffer(r["values"], np.int64).reshape(-1, latent.SKETCHED) for r in sketch.orderBy("block").collect()])
    parity = np.abs(rows).sum(1).astype(int) - exact.sum(0).astype(int)
    assert (parity % 2 == 0).all() and (parity <= 0).all() and (np.abs(rows).sum(1)[exact.sum(0) == 1] == 1).all()
    made, squared = latent.corpus_directions(sketch, idf)
    exact *= idf
    values, left = np.linalg.eigh((exact @ exact.T).astype(np.float64))
    top = (exact.T @ left[:, -5:]) / np.sqrt(values[-5:])
    assert abs(squared / (exact**2).sum() - 1) < 0.2
    assert (np.linalg.norm(np.linalg.qr(made[-5:].T)[0].T @ top, axis=0) > 0.9).all()
    again = latent.corpus_directions(latent.counts(docs.repartition(3))[1], idf)[0]
    assert np.allclose(np.abs(made[-5:]), np.abs(again[-5:]), atol=1e-3)


def test_bound_before_the_subsequence_loses_nothing():
    """Ranges that the bound turns down have no common subsequence of that share; most of those without one are turned down."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(60) if rng.random() < 0.7 else rng.randrange(4000)}" for _ in range(3000)]
    text, of_item = " ".join(words), [[x for x in words[200 * i : 205 + 209 * i] if rng.random() < 0.9] for i in range(6)]
    items = latent.Items([(i, " ".join(x)) for i, x in enumerate(of_item)], np.zeros((latent.PLACES, 3), np.float32), np.ones(6))
    hashes = latent._words(pa.array([text]))[0]
    item = np.array([i for i in range(6) for _ in range(200)])
    begin = np.array([rng.randrange(2900) if rng.random() < 0.8 else 200 * i + rng.randrange(10) for i in item])
    end = np.minimum(3000, begin + 20 + np.array([rng.randrange(120) for _ in item]))
    can = set(latent._can_hold(items, item, latent._places(hashes) % latent._BUCKETS, begin, end, 0.5).tolist())
    true = {k for k, (i, a, b) in enumerate(zip(item, begin, end, strict=True)) if latent.lcs_length(items.masks[i], int(items.n[i]), hashes[a:b].tolist()) >= 0.5 * items.n[i]}
    assert true and true <= can and len(can) < len(item)
    assert len(latent._can_hold(items, item[:0], hashes[:0], begin[:0], end[:0], 0.5)) == 0
