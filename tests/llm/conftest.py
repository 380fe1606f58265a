import pytest

SMALL = "/root/testdata/sf0.001"  # tests above this folder import it from the conftest that was loaded last, which is this one
DOC = "doc_id long, text string, lang string, source string, n_chars long, t long, node string, g long, level int, ids binary"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names an
    operator might use itself."""

    def make(*rows):
        return spark.createDataFrame([(i, x, None, None, None, 1, "n", 2, 3, None) for i, x in rows], DOC)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_ = " ".join(f"w{i}" for i in range(60_000))
    return docs((1, None), (2, ""), (None, "a b c"), (3, long_), (3, long_), (4, " \n\t "), (4, "x"), (5, "x"), (None, None), (6, "é" * 5_000), (7, "7" * 5_000), (8, "a@" * 2_000))
