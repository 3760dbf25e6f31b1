import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a table with the columns of documents and some whose names operators use themselves."""

    def make(rows):
        data = [(i, t, "en", "s", len(t or ""), "x", 1, [1]) for i, t in rows]
        return spark.createDataFrame(data, DOCS + ", shard string, n int, items array<int>")

    return make


@pytest.fixture(autouse=True)
def shipped(spark):
    from parchwork.plans.session import ship

    ship(spark)
