import pytest
from pyspark.sql import types as T

from marginalia.shipping import ship

CLASHES = ("_id", "_text", "_key", "set", "size", "rank", "kept", "keep_id", "score", "n_tokens", "spans", "class_id")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with extra columns whose names the operators use themselves."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHES),
    ])

    def make(rows):
        """rows of (doc_id, text) or (doc_id, text, lang)."""
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), *("x" for _ in CLASHES))
            for r in rows
        ]
        return spark.createDataFrame(full, schema)

    return make
