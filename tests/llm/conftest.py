import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXTS = [None, "", " \n ", "a", "one two three", "one two three", "x " * 50, "line one here\nline one here\nother\n", "é è ß ñ 漢字 \x1c q", "w" * 5000, " ".join(f"w{i}" for i in range(25))]


@pytest.fixture
def odd(spark):
    """Nulls, empty and repeated rows, a null and a repeated id, clashing extra columns."""
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", f"src{i % 2}", 0, "z", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5]]
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "row"]
    kinds = [LongType(), StringType(), StringType(), StringType(), LongType(), StringType(), LongType()]
    return spark.createDataFrame(rows, StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
