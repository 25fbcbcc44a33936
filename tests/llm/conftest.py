import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows, and columns named like results."""
    r = random.Random(5)
    syllables = "an er th on in re st en".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    long = " ".join(word() for _ in range(60_000))
    plain = " ".join(word() for _ in range(200))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, plain), (5, plain), (5, plain), (None, plain), (None, None), (6, long),
            (7, plain.upper()), (8, "idiot <|endoftext|> x"), (8, "other text with the same id"), (9, "漢字 😀 é\n\n a  b")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *[T.StructField(n, T.StringType()) for n in ("lang", "score", "shard", "node", "_row", "_id", "ids", "length")]])
    return spark.createDataFrame([(i, t, "en", *"abcdefg") for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id = -1")
