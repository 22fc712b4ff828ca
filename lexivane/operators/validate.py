"""Checks of papers and search requests. Every broken rule becomes a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions import text as X
from lexivane.operators.planning import with_column_once
from lexivane.options import DEFAULT_TOP_K, MAX_TOP_K, MIN_TOP_K

# Column, longest, required.
TEXT_RULES = [
    ("paper_id", 64, True),
    ("title", X.TITLE_CHARS, True),
    ("abstract", None, True),
    ("authors", X.AUTHORS_CHARS, False),
    ("venue", X.VENUE_CHARS, False),
    ("doi", X.DOI_CHARS, False),
    ("category", X.CATEGORY_CHARS, False),
]
PAPER_YEARS, REQUEST_YEARS = (1500, 2100), (1800, 2100)
QUERY_CHARS, CATEGORY_FILTER_CHARS = (2, 2000), 200
# One character class: alternatives would recurse once per character of a long text.
CATEGORY_FILTER = rf"^[A-Za-z0-9.,_\-{X.WHITESPACE_RANGES}]+\z"


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules whose condition is true."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def outside(value: Column, low: int, high: int) -> Column:
    return value.isNotNull() & ~value.between(low, high)


def paper_reasons() -> Column:
    rules = []
    for name, longest, required in TEXT_RULES:
        column = F.col(name)
        if required:
            rules.append((column.isNull() | (column == ""), f"{name} missing"))
        if longest:
            rules.append((F.length(column) > longest, f"{name} too long"))
    rules.append((outside(F.col("year"), *PAPER_YEARS), "year out of range"))
    # A title of blanks passes the length rule but leaves nothing to embed.
    blank = X.combined_text(F.col("title"), F.col("abstract")) == ""
    rules.append((blank & (F.col("title") != "") & (F.col("abstract") != ""), "text blank"))
    return reasons(*rules)


def validate_papers(papers: DataFrame) -> DataFrame:
    return with_column_once(papers, "reasons", paper_reasons())


def valid_papers(papers: DataFrame, mode: str = "fail") -> DataFrame:
    """Valid rows. ``fail``: the first invalid row stops the job;
    ``quarantine``: invalid rows are left to ``rejected_papers``."""
    checked = validate_papers(papers)
    clean = F.size("reasons") == 0
    if mode == "fail":
        message = F.concat(
            F.lit("invalid paper "), F.col("paper_id"), F.lit(": "), F.concat_ws(", ", "reasons")
        )
        clean = F.when(clean, True).otherwise(
            F.raise_error(F.coalesce(message, F.lit("invalid paper without id"))).cast("boolean")
        )
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode}")
    return checked.filter(clean).drop("reasons")


def rejected_papers(papers: DataFrame) -> DataFrame:
    return validate_papers(papers).filter(F.size("reasons") > 0)


def category_filter(pattern: Column) -> tuple[Column, Column]:
    """A category filter as it is used (null: none), and why it cannot be, or null."""
    wanted = F.nullif(X.strip(pattern), F.lit(""))
    fault = F.when(F.length(pattern) > CATEGORY_FILTER_CHARS, "too long").when(
        ~wanted.rlike(CATEGORY_FILTER), "characters"
    )
    return wanted, fault


def category_matches(category: Column, wanted: Column) -> Column:
    """Case-insensitive substring; ``_`` stands for any one character."""
    return F.like(F.upper(category), F.concat(F.lit("%"), F.upper(wanted), F.lit("%")))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with trimmed query and category filter, default top_k and reasons."""
    query, pattern = F.col("query"), F.col("category_contains")
    trimmed, (wanted, _) = X.strip(query), category_filter(pattern)
    top_k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K))
    low, high = F.col("min_year"), F.col("max_year")
    return requests.withColumn(
        "reasons",
        reasons(
            (query.isNull(), "query missing"),
            (~F.length(query).between(*QUERY_CHARS), "query length"),
            (
                F.length(query).between(*QUERY_CHARS) & (F.length(trimmed) < QUERY_CHARS[0]),
                "query too short after trim",
            ),
            (~top_k.between(MIN_TOP_K, MAX_TOP_K), "top_k out of range"),
            (outside(low, *REQUEST_YEARS), "min_year out of range"),
            (outside(high, *REQUEST_YEARS), "max_year out of range"),
            (low > high, "min_year greater than max_year"),
            (F.length(pattern) > CATEGORY_FILTER_CHARS, "category filter too long"),
            (~wanted.rlike(CATEGORY_FILTER), "category filter characters"),
        ),
    ).withColumns({"query": trimmed, "top_k": top_k, "category_contains": wanted})
