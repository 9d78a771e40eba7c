import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql.types import LongType, StringType, StructField, StructType  # noqa: E402

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table of (doc_id, text[, source]) rows, with a column of a clashing name."""

    def make(rows, clash="words"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "host") for r in rows]
        made = spark.createDataFrame(full, SCHEMA).repartition(3)
        return made.selectExpr("*", f"'x' AS {clash}", "1 AS hash", "2 AS key", "3 AS text2")

    return make


#: rows that every operator takes: null id, null, empty and blank texts, repeated rows, one id with two texts
ODD = [
    (None, "some words stand here without any id at all"),
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same row twice"), (5, "same row twice"),
    (6, "one id"), (6, "and two texts"), (7, "é ñ 你好 \U0001F600 " * 30), (8, "x" * 20_000), (9, "a b " * 8_000),
]


@pytest.fixture()
def odd(documents):
    return documents(ODD)
