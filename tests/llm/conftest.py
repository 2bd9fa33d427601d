import pytest
from pyspark.sql import types as T

from corpusloom.runtime import ship_package

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        *[T.StructField(n, T.StringType()) for n in ("id", "key", "n", "label", "score", "rid", "tokens", "block", "component", "ranges", "lines")],
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows of (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + ("x",) * 11 for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
