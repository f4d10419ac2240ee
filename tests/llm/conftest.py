import pytest

ODD_TEXTS = [
    None, "", " \n\t ", "a", "Hello, world!", "x" * 5000, "ab " * 3000, "word " * 120, "la la la la", "日本語 текст ñandú 🙂 x²½",
    "<|endoftext|> in text", "'s don't I'LL", "line\nline\nline\n", "\x1c\x85\xa0 mixed   space\r\n", "0123456789 " * 20, "THE END!! " * 40,
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, an extra column that clashes with names used inside."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a row without an id", "en", "src", 1), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents, as rows and as a table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}
