"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT = T.StringType(), T.IntegerType()

# A paper as it is handed in.
PAPER_IN = (
    T.StructType()
    .add("paper_id", TEXT)
    .add("title", TEXT)
    .add("abstract", TEXT)
    .add("authors", TEXT)
    .add("year", INT)
    .add("venue", TEXT)
    .add("doi", TEXT)
    .add("category", TEXT)
)
PAPER_COLUMNS = PAPER_IN.fieldNames()

# A stored paper. ``created_at`` is set on insert and kept by updates.
PAPER = (
    T.StructType(list(PAPER_IN.fields))
    .add("combined_text", TEXT)
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("created_at", T.TimestampType())
)

# The sign codes of the approximate index, with the columns filters need.
CODES = (
    T.StructType()
    .add("paper_id", TEXT)
    .add("year", INT)
    .add("category", TEXT)
    .add("code", T.ArrayType(T.LongType()))
)

# A search request.
REQUEST = (
    T.StructType()
    .add("query_id", T.LongType())
    .add("query", TEXT)
    .add("top_k", INT)
    .add("min_year", INT)
    .add("max_year", INT)
    .add("category_contains", TEXT)
)
