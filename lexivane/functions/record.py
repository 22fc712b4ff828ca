"""Columns of a paper row out of a loose metadata record (a VARIANT)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.functions import text as X

PAPER_ID_CHARS = 64


def field(record: Column, name: str) -> Column:
    """A field as text; absent and JSON null are both null."""
    return F.try_variant_get(record, f"$['{name}']", "string")


def string_at(record: Column, path: str) -> Column:
    """The value at a path if it is a JSON string, else null."""
    kind = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(record, path, "string"))


def paper_id(raw: Column) -> Column:
    ident = F.replace(X.strip(F.coalesce(raw, F.lit(""))), F.lit("/"), F.lit("-"))
    return F.when(ident == "", F.lit("unknown")).otherwise(F.substring(ident, 1, PAPER_ID_CHARS))


def leading_year(date: Column) -> Column:
    """The first four characters as a number, null when they are none."""
    return F.regexp_extract(date, "(?s)^.{4}", 0).try_cast("int")


def record_year(record: Column) -> Column:
    """Year of the update date; failing that, of the first version.

    The first version is an object with a creation date or a bare date string.
    """
    return F.coalesce(
        leading_year(string_at(record, "$.update_date")),
        leading_year(string_at(record, "$.versions[0].created")),
        leading_year(string_at(record, "$.versions[0]")),
    )


def authors(raw: Column) -> Column:
    return F.nullif(F.substring(raw, 1, X.AUTHORS_CHARS), F.lit(""))


def stripped_or_null(raw: Column, chars: int) -> Column:
    """Doi and venue: stripped, cut, null when nothing is left."""
    return F.nullif(F.substring(X.strip(raw), 1, chars), F.lit(""))


def category(raw: Column) -> Column:
    return F.nullif(F.substring(raw, 1, X.CATEGORY_CHARS), F.lit(""))


def category_listed(raw: Column, codes: Sequence[str]) -> Column:
    """True when the category string contains one of the codes; null counts as no."""
    hit = reduce(or_, [raw.contains(code) for code in codes], F.lit(False))
    return F.coalesce(hit, F.lit(False))
