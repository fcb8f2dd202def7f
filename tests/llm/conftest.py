import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: Nulls in every column, empty and long texts, ties, repeated rows.
EDGES = [
    (1, "Hello there world", "en", "b", 17), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "  \t\n", None, "a", 4), (5, "word", "en", "", 4), (5, "word", "en", "", 4),
    (5, "word", "fr", "b", 4), (None, "no id here", "en", "a", 10), (None, None, None, None, None), (6, "é ß 日本 😀 ▁ \u212a İ", "en", "b", 18), (7, "x" * 20_000, "en", "a", 20_000),
    (8, "long words " * 5_000, "en", "c", 55_000), (-9, "Hello  there\nworld", "en", "b", 18), (10, "123 456 !!", None, "c", 10), (2**62, "big id", "en", "b", 6), (11, "same text", "en", "a", 9), (12, "same\u00a0text", "en", "a", 9),
]
CLASHES = ["rid", "digest", "fp", "rank", "kept", "bucket", "key", "size", "source_size", "label", "w", "h", "_skein_rid2", "_skein_rid", "_skein_lang", "_rid", "_copy", "score", "lead", "word", "n", "part", "norm", "first"]


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """The edge rows with extra columns of clashing names, from a file."""
    path = str(tmp_path_factory.mktemp("edges") / "t")
    rows = spark.createDataFrame(EDGES, DOCS)
    rows.withColumns({c: F.lit("clash") for c in CLASHES}).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "t")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
