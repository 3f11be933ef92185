import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from talewind.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in langid.predicted(odd).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0
    assert rows[3].lang_pred == "en" and rows[None].held_out is False
    assert langid.predicted(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predicted(unlabelled).collect()} == {"und"}


def test_family_comes_first():
    rng = np.random.default_rng(1)
    texts, langs = [], []
    for lang, words in {"de": "der die und nicht", "en": "the and not with", "fr": "le les et pas", "es": "el los y no", "xx": "qa zu wo qi"}.items():
        for _ in range(60):
            texts.append(" ".join(rng.choice(words.split(), 12)))
            langs.append(lang)
    model = langid.Hierarchy(langid.features(pa.array(texts)), np.array(langs, dtype=object))
    assert model.top.classes == ["=xx", "germanic", "romance"] and [m.classes for m in model.within] == [["xx"], ["de", "en"], ["es", "fr"]]
    best, sure = model(langid.features(pa.array(["der und die", "los y el", "with the not", "zu qi qa"])))
    assert best.tolist() == ["de", "es", "en", "xx"] and ((0 <= sure) & (sure <= 1)).all()


def test_features_stay_within_a_text():
    x = langid.features(pa.array(["ab", "cd", "", None, "abcd"]))
    assert not x[2].any() and not x[3].any() and not x[0].any()
    assert np.allclose(langid.features(pa.array(["abcd"]))[0], x[4])


def test_more_languages_than_machines_of_one_versus_one(spark, monkeypatch):
    # Each language has words of its own; with so few classes allowed at once, families and languages are parted in halves.
    rng, rows = np.random.default_rng(2), []
    for lang in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 10)), f"x{lang:02}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r.doc_id: r.lang_pred for r in langid.predicted(frame).collect()}
    assert len(found) == len(rows) and np.mean([found[i] == lang for i, _, lang in rows]) > 0.9
    monkeypatch.setattr(langid, "MOST_CLASSES", 3)
    texts, langs = pa.array([t for _, t, _ in rows[:200]]), np.array([x for _, _, x in rows[:200]], dtype=object)
    model = langid.Hierarchy(langid.features(texts), langs, {x: "one" for x in set(langs)})
    best, sure = model(langid.features(texts))
    assert isinstance(model.within[0], langid.Halves) and np.mean(best == langs) > 0.9 and ((0 <= sure) & (sure <= 1)).all()
