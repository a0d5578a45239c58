import pytest
from pyspark.sql import types as T

#: Words that make texts long enough to matter.
LONG = " ".join(f"w{k}" for k in range(3000))
PASSAGE = " ".join(f"passage{k} of text" for k in range(30))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns whose names operators use inside."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (None, "the quick brown fox jumps over the lazy dog again and again", None, None, None),
        (3, None, "en", "b", None),
        (4, "", "fr", "b", 0),
        (5, " \t\n\r ", None, "b", 5),
        (6, LONG, "de", "c", len(LONG)),
        (7, LONG + " more", "de", "c", len(LONG) + 5),
        (8, "before " + PASSAGE + " after", "en", "c", 1),
        (9, "other start " + PASSAGE + " other end", "en", "c", 1),
        (10, "ünïcödé 大熊 wörter ß " * 20, "de", "d", 1),
        (11, "a" * 1000, "en", "d", 1000),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (12, "123 456 !!! ###", "en", "d", 1),
    ]
    extra = ("key", "n", "k1", "k2", "fp", "row", "size", "bytes", "root", "ids", "h", "id", "w0", "shard", "x", "text_", "__text", "__leaks", "__key", "__row", "meta.lang", "tick`ed", "c0", "left", "leaks", "signature", "c")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in extra)])
    return spark.createDataFrame([(*r, *(f"{c}-value" for c in extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def small(docs):
    """Documents as (id, text), for plain versions."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


class Sets:
    """Disjoint sets, for plain versions."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            x = y
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


@pytest.fixture
def sets():
    return Sets()
