"""Fixtures of the training-data tests: a table of awkward documents, and writing of small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def documents(spark, tmp_path):
    """``documents`` read from Parquet, of (id, text) or (id, text, source)."""

    def build(rows, name="documents", extra=()):
        full = [(row[0], row[1], "en", row[2] if len(row) > 2 else "src0", len(row[1] or "")) for row in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        for column in extra:
            frame = frame.selectExpr("*", f"'x' AS `{column}`")
        path = str(tmp_path / f"{name}.parquet")
        frame.coalesce(2).write.mode("overwrite").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return build


@pytest.fixture
def awkward():
    """Nulls, empty and blank texts, one very long text, one very long word, repeated rows and equal texts."""
    plain = "The quick brown fox jumps over the lazy dog near the river bank today."
    return [
        (1, plain),
        (1, plain),
        (2, plain),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, plain + " Without an id."),
        (6, "x" * 30_000),
        (7, "word of many kinds, " * 4_000 + "\n" + plain),
        (8, "Größe été niño 漢字 😀   end\r\n<|endoftext|>don't"),
        (9, "one two"),
    ]
