import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and a clashing extra column."""
    rows = [(0, None, None), (1, "", "en"), (2, " \n\t", None), (3, "x", "en"), (3, "x", "en"), (4, "123 !!", "de"), (None, "a b c d e f", "fr"), (5, "long " * 60000, "en")]
    return spark.createDataFrame([(*r, 0.0, 0) for r in rows], "doc_id long, text string, lang string, score double, y int")
