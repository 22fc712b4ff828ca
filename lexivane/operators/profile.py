"""Corpus profile and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text as X

# Characters shown per column.
TITLE_SHOWN, CATEGORY_SHOWN, SNIPPET_SHOWN = 72, 36, 160


def count_papers(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("papers_count"))


def corpus_profile(
    corpus: DataFrame, model: str, dim: int, indexed: bool, use_approximate: bool
) -> DataFrame:
    """One row: status, count, model, dimension, index and the path searches take."""
    size = F.size("embedding")
    return corpus.agg(
        F.count(F.lit(1)).alias("papers_count"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
        F.min(F.when(F.col("embedding").isNotNull(), size)).alias("min_dimension"),
        F.max(F.when(F.col("embedding").isNotNull(), size)).alias("max_dimension"),
    ).select(
        F.lit("ok").alias("status"),
        "papers_count",
        F.lit(model).alias("embedding_model"),
        F.lit(dim).alias("embedding_dimension"),
        "without_vector",
        "min_dimension",
        "max_dimension",
        F.lit("yes" if indexed else "no").alias("vector_index"),
        F.lit("approximate" if indexed and use_approximate else "exact").alias("search_path"),
    )


def display_rows(results: DataFrame, snippet_chars: int = SNIPPET_SHOWN) -> DataFrame:
    """Results in short form for reading."""
    lead = [c for c in ("query_id", "rank") if c in results.columns]
    return results.select(
        *lead,
        "paper_id",
        F.substring("title", 1, TITLE_SHOWN).alias("title"),
        "year",
        F.substring(F.coalesce("category", F.lit("")), 1, CATEGORY_SHOWN).alias("category"),
        F.coalesce(F.nullif("authors", F.lit("")), F.lit("Unknown authors")).alias("authors"),
        F.round("similarity", 4).alias("similarity"),
        F.round("distance", 6).alias("distance"),
        X.snippet(F.col("abstract"), snippet_chars).alias("abstract_snippet"),
    )
