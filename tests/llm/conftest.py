import pytest
from odd_rows import CLASHING, ODD
from pyspark.sql import functions as F

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as the operators name theirs."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 1000000")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
