import pytest

from tidelog.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "One two three four five six seven eight nine ten eleven.\nAnother line of ten words that is only here, once.", "en", "a", 5),
        (1, "One two three four five six seven eight nine ten eleven.\nAnother line of ten words that is only here, once.", "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "fr", None, 4),
        (None, "One two three four five six seven eight nine ten eleven.", None, "b", 3),
        (5, long, "en", "b", len(long)),
        (6, long + " tail", "en", "b", None),
        (7, "é🙂 ünïcode  \x00 zero", "de", "c", 1),
    ]
    extra = [(*r, i, "x", True, 7, 8) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOCS + ", text_hash long, spans string, kept boolean, n_tokens int, shard int")


def fresh(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
