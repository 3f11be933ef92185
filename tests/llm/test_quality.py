import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest

from talewind.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in earlier
        earlier.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[x] for x in quality.COUNTS) == want, r
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_counts(spark, documents, sf):
    rows = quality.judged(documents, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(rows) == documents.count()
    check(rows, {r.doc_id: r.text for r in documents.collect()})


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    verdicts = quality.judged(odd, labels)
    rows = verdicts.collect()
    assert len(rows) == 13
    check([r for r in rows if r["doc_id"] is not None], {r.doc_id: r.text for r in odd.collect()})
    kept = quality.kept_documents(odd, verdicts)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows) == 1
    assert quality.judged(odd.limit(0), labels).count() == 0
    assert quality.judged(odd, labels.limit(0)).count() == 13


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, Fraction(1, 10)), (3, 50, Fraction(1, 50)), (7, 7, Fraction(1, 3)), (40, 400, Fraction(1, 8))])
def test_binomial_tail(k, n, p):
    exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_tail(k, n, float(p)) == pytest.approx(float(exact), rel=1e-9)


def test_cutoff_keeps_the_guarantee():
    lost = [1000, 60, 9, 3, 0, 0]
    b = quality.lowest_cutoff(lost, 1000, 0.02, 0.01)
    assert b == 2 and quality.binomial_tail(lost[1], 1000, 0.02) > 0.01
    assert quality.lowest_cutoff([100, 0], 100, 0.02, 0.01) is None


def test_rules_reject_what_labels_show(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()
    good = [(i, " ".join(words[(i * j * j + j) % 14] + str(i * j) for j in range(30)), "en", 1) for i in range(1, 1500)]
    bad = [(5000 + i, " ".join(words[(i * j + j) % 14] + f"{i}!! ###" for j in range(30)), "en", 0) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, quality int")
    verdicts = quality.judged(docs, docs.select("doc_id", "quality")).select("doc_id", "kept").collect()
    lost = sum(not r.kept for r in verdicts if r.doc_id < 5000)
    assert lost <= 0.02 * len(good) and not any(r.kept for r in verdicts if r.doc_id >= 5000)


def test_toxic_documents_are_not_good(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()
    text = lambda i, more: " ".join([words[(i * j * j + j) % 14] + str(i * j) for j in range(30)] + more)
    good = [(i, text(i, []), "en", 1, 0) for i in range(1, 1500)]
    toxic = [(5000 + i, text(5000 + i, ["Nasty,", "vile"]), "en", 1, 1) for i in range(200)]
    docs = spark.createDataFrame(good + toxic, "doc_id long, text string, lang string, quality int, toxic int")
    labels = docs.select("doc_id", "quality", "toxic")
    assert {"nasty", "vile"} <= set(quality.toxic_words(docs, labels)["en"])
    kept = {r.doc_id for r in quality.judged(docs, labels).filter("kept").collect()}
    assert sum(i not in kept for i in range(1, 1500)) <= 0.02 * len(good) and not any(i >= 5000 for i in kept)
