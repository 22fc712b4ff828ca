"""Optional search filters: year range and category."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.operators.validate import category_filter, category_matches

def search_predicate(
    min_year: int | None = None,
    max_year: int | None = None,
    category: str | None = None,
) -> Column | None:
    """The filters that are set, joined by AND; None when none is."""
    if None not in (min_year, max_year) and max_year < min_year:
        raise ValueError(f"years {min_year} to {max_year} are an empty range")
    parts = []
    if min_year is not None:
        parts.append(F.col("year") >= int(min_year))
    if max_year is not None:
        parts.append(F.col("year") <= int(max_year))
    if category is not None:
        wanted, fault = category_filter(F.lit(category))
        like = category_matches(F.col("category"), wanted)
        refused = F.raise_error(F.concat(F.lit("category filter "), F.lit(category), F.lit(": "), fault))
        parts.append(F.when(fault.isNotNull(), refused.cast("boolean")).when(wanted.isNull(), True).otherwise(like))
    return reduce(and_, parts) if parts else None


def apply_filters(corpus: DataFrame, **filters) -> DataFrame:
    predicate = search_predicate(**filters)
    return corpus if predicate is None else corpus.filter(predicate)
