import pytest

ROWS = "doc_id long, text string, lang string, source string, key string, row string, words string, size int"


@pytest.fixture
def documents(spark):
    """Texts to a table of documents with columns whose names operators use inside; ids count up unless given."""

    def make(texts, ids=None, sources=None, langs=None):
        n = len(texts)
        ids, sources, langs = ids or list(range(n)), sources or ["a"] * n, langs or ["en"] * n
        rows = [(i, t, lang, s, "k", "r", "w", 1) for i, t, s, lang in zip(ids, texts, sources, langs)]
        return spark.createDataFrame(rows, ROWS)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and blank texts, a repeated row, ties, and a very long text."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", "  \n ", "one two three", "one two three", "one two three", long, None, "ünï cödé!"]
    return documents(texts, ids=[0, 1, 2, 3, 3, 4, 5, None, None], sources=[None, "a", "b", "a", "a", "b", None, "a", "b"])


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def items(spark):
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.fixture
def by_id():
    """Rows as dicts by doc_id; of repeated rows the last."""
    return lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
