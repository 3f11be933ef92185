import corpus_pipeline
from talewind.llm.jaccard import near_duplicates
from talewind.llm.pii import PATTERNS


def test_stages_on_a_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == given, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    assert docs.filter(docs["text"].rlike(PATTERNS["email"])).count() == 0
    assert near_duplicates(docs).filter("component_id <> doc_id").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_odd_rows(spark, odd, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, sf)
            assert out.columns == odd.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0
