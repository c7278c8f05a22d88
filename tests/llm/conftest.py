import random

import pytest
from pyspark.sql import types as T

#: The columns of documents, with others whose names may clash with what operators use inside.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("id", "n", "score", "shard", "digest", "spans", "token", "count", "body", "key", "row")),
    ]
)
EXTRA = ("x",) * 11


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None, *EXTRA) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, repeated, non-ASCII, odd white space and very long texts."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(30_000))
    texts = [None, "", "  \n\t", "One", "one two", "A b C", "a B c", "É é ß  x", "tab\tand\x0bfeed\x0c end", "\U0001f600 世界", long, long, "same same same same same same", "same same same same same same"]
    return list(enumerate(texts))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
