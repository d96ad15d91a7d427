import pytest
from pyspark.sql import types as T

#: Column names that operators use inside, to provoke clashes.
ODD = ["id", "hash", "n", "d", "e", "k", "digest", "text_hash", "bands", "spans", "_row", "_text", "_id", "_hash", "component_id", "stratum", "h"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, a very long text and clashing column names."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    block = "\n".join(prose(9) for _ in range(12))
    rows = [
        (1, prose(80)), (2, None), (3, ""), (4, " \n\t "), (5, prose(40_000)), (6, "\n".join([prose(20), block, prose(20)])), (7, "\n".join([prose(5), prose(5), block, prose(30)])),
        (8, "one two"), (9, "one two"), (None, prose(60)), (10, prose(90)), (10, prose(90)), (11, "日本語 " * 30), (12, "x" * 5000), (13, "a\x00b ▁ c"),
    ]
    rows += [rows[0], (14, rows[0][1])]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in ODD]])
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, *["x"] * len(ODD)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
