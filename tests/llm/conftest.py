import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = {"score": "x", "_row": 1, "row": 2, "key": "k", "spans": 3, "base": 4, "component_id": 5, "removed": 6, "id": 7, "fp": 8}


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated, tied and very long texts, with columns whose names the operators use themselves."""
    long = "word%d and more " * 1
    big = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "One line only.", "en", "b"), (4, "One line only.", "en", "b"),
        (5, "One line only.", "en", "b"), (None, "No key here, but words enough to count as a text.", "en", None), (6, big, "en", "c"), (7, big, "en", "c"), (8, "日本語 ééé 😀", "fr", "c"), (9, long, "en", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
