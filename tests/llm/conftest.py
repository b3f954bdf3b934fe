import pytest

from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def made(spark):
    """A documents table of (doc_id, text, lang, source), with n_chars."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(made):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 40_000
    return made(
        [
            (1, None, None, None),
            (2, "", "en", "a"),
            (3, "   \n\t ", "en", "a"),
            (4, "one two three", "en", "a"),
            (4, "one two three", "en", "a"),
            (4, "one two four", "en", "b"),
            (None, "no id here at all", "fr", None),
            (None, None, None, None),
            (5, long, "en", "b"),
            (6, "ünï cödé 漢字 \U0001f600   x", "de", None),
            (7, "one two three", None, "c"),
        ]
    )
