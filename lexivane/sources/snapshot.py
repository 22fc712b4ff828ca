"""Metadata snapshots: one JSON object per line.

Parsing takes a frame with a ``value`` column, so files, streams and tables all
use the same code. Rows are parsed into VARIANT because the shape of a field
may differ from row to row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexivane.functions import record as R
from lexivane.functions import text as X
from lexivane.operators.planning import broadcast_keys, with_column_once
from lexivane.options import DEFAULT_CATEGORIES, check_cap
from lexivane.schema import PAPER_IN
from lexivane.session import work_dir

PAPER_COLUMNS = PAPER_IN.fieldNames()
# Where a line stood: file, start of its split, running number within the split.
POSITION = ["file", "block", "line"]


def with_split(lines: DataFrame) -> DataFrame:
    return lines.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def positioned(lines: DataFrame) -> DataFrame:
    """Adds the position columns to a frame read from files."""
    return with_split(lines).withColumn("line", F.monotonically_increasing_id())


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return positioned(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``record`` and ``fault``; ``value`` becomes valid, stripped text.

    ``fault`` is null for a usable record, else ``blank``, ``bad json`` or
    ``not an object``.
    """
    text = X.strip(F.make_valid_utf8(F.col("value")))
    parsed = with_column_once(
        lines.withColumn("value", text), "record", F.try_parse_json("value")
    )
    return parsed.withColumn(
        "fault",
        F.when(F.col("value") == "", "blank")
        .when(F.col("record").isNull(), "bad json")
        .when(~F.col("value").startswith("{"), "not an object"),
    )


def records(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).filter(F.col("fault").isNull()).drop("fault")


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that are skipped with a warning; blank ones are skipped without."""
    return parse_lines(lines).filter(F.col("fault").isNotNull() & (F.col("fault") != "blank"))


# Record fields read as text, and the column each becomes.
RAW_FIELDS = {
    "raw_id": "id",
    "raw_title": "title",
    "raw_abstract": "abstract",
    "raw_authors": "authors",
    "raw_categories": "categories",
    "raw_doi": "doi",
    "raw_venue": "journal-ref",
}


def _raw(records: DataFrame, *more: str) -> DataFrame:
    keep = [c for c in records.columns if c not in ("value", "record", *more)]
    fields = [R.field(F.col("record"), name).alias(column) for column, name in RAW_FIELDS.items()]
    return records.select(*keep, *more, "record", *fields)


def _listed(categories: Sequence[str]) -> Column:
    return R.category_listed(F.col("raw_categories"), categories)


def _with_text() -> Column:
    return (X.strip(F.col("raw_title")) != "") & (X.strip(F.col("raw_abstract")) != "")


def paper_columns() -> list[Column]:
    record = F.col("record")
    return [
        R.paper_id(F.col("raw_id")).alias("paper_id"),
        X.clean_title(F.col("raw_title")).alias("title"),
        X.clean_abstract(F.col("raw_abstract")).alias("abstract"),
        R.authors(F.col("raw_authors")).alias("authors"),
        R.record_year(record).alias("year"),
        R.stripped_or_null(F.col("raw_venue"), X.VENUE_CHARS).alias("venue"),
        R.stripped_or_null(F.col("raw_doi"), X.DOI_CHARS).alias("doi"),
        R.category(F.col("raw_categories")).alias("category"),
    ]


def papers_from(
    records: DataFrame, categories: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """Paper rows of the listed categories that have a title and an abstract.

    Rows are dropped by their raw fields, before any text is cleaned.
    """
    keep = [c for c in records.columns if c not in ("value", "record")]
    return _raw(records).filter(_listed(categories) & _with_text()).select(*keep, *paper_columns())


PAPER, LINE = "paper", "line"
# What becomes of the lines of a snapshot, as counted while they are parsed.
OUTCOMES = ("papers", "bad_json", "not_object", "blank", "unlisted", "no_text", "unknown_ids")


def sorted_out(
    lines: DataFrame, categories: Sequence[str] = DEFAULT_CATEGORIES
) -> tuple[DataFrame, Observation]:
    """Papers and rejected lines of one parse, and the counts of all outcomes.

    ``kind`` tells papers from lines; a paper has no ``value``, a line no paper columns but
    its ``fault``. The counts are there when the rows have been written once.
    """
    keep = [c for c in lines.columns if c != "value"]
    raw = _raw(parse_lines(lines), "fault", "value")
    outcome = (
        F.when(F.col("fault") == "blank", "blank")
        .when(F.col("fault") == "bad json", "bad_json")
        .when(F.col("fault").isNotNull(), "not_object")
        .when(~F.coalesce(_listed(categories), F.lit(False)), "unlisted")
        .when(~F.coalesce(_with_text(), F.lit(False)), "no_text")
        .otherwise("papers")
    )
    told = with_column_once(raw, "outcome", outcome)
    is_paper = F.col("outcome") == "papers"
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES[:-1]]
    unknown = F.count_if(is_paper & (R.paper_id(F.col("raw_id")) == "unknown")).alias("unknown_ids")
    seen = Observation()
    wanted = told.observe(seen, *counts, unknown).filter(F.col("outcome").isin("papers", "bad_json", "not_object"))
    rows = wanted.select(
        *keep,
        F.when(is_paper, PAPER).otherwise(LINE).alias("kind"),
        F.when(~is_paper, F.col("value")).alias("value"),
        "fault",
        *paper_columns(),
    )
    return rows, seen


def write_sorted_out(
    lines: DataFrame, folder: str, categories: Sequence[str] = DEFAULT_CATEGORIES
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Papers, rejected lines (with their fault) and counts; the lines are parsed once."""
    rows, seen = sorted_out(lines, categories)
    rows.write.partitionBy("kind").parquet(folder)
    spark = lines.sparkSession
    written = spark.read.schema(T.StructType([*rows.schema.fields])).parquet(folder)
    papers = written.filter(F.col("kind") == PAPER).drop("kind", "value", "fault")
    bad = written.filter(F.col("kind") == LINE).drop("kind", *PAPER_COLUMNS)
    return papers, bad, {name: seen.get[name] for name in OUTCOMES}


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order; filters are applied before the call.

    Rows are counted per file split, and a running sum over the splits tells how many
    each one gives. Only that table of splits is ordered; the rows themselves
    are neither sorted nor shuffled, so they must come straight from a scan.
    """
    check_cap(n)
    return _quota(rows.withColumn("place", F.monotonically_increasing_id()), n).select(*rows.columns)


def _quota(numbered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of rows whose ``place`` runs through each of their splits."""
    counts = numbered.groupBy("file", "block").agg(
        F.count("*").alias("rows"), F.min("place").alias("first")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.select(
        "file", "block", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    ).filter(F.col("before") < n)
    inside = F.col("place") - F.col("first") < F.lit(n) - F.col("before")
    # Every split in the quota gives a row, so there are at most n of them.
    return numbered.join(broadcast_keys(quota, n), ["file", "block"]).filter(inside)


def files_in_order(lines: DataFrame) -> list[str]:
    """The files a frame would read, in the order ``first_rows`` counts them."""
    return sorted(lines.inputFiles())


def first_of_files(files: Sequence[str], read: Callable[[list[str]], DataFrame], n: int) -> DataFrame:
    """The first ``n`` rows of ``read(files)`` in file order, without opening later files.

    Files are read in steps, each of twice as many as the one before; no further step is
    begun when there are enough rows. What a step parses is written, so nothing is parsed
    again to cut the rows to ``n``. ``read`` gives rows with their position, filters applied.
    """
    check_cap(n)
    parts, found, at, step = [], 0, 0, 1
    while found < n and at < len(files):
        rows = read(list(files[at : at + step])).withColumn("place", F.monotonically_increasing_id())
        path = work_dir(rows.sparkSession, "first")
        rows.write.parquet(path)
        parts.append(rows.sparkSession.read.schema(rows.schema).parquet(path))
        found += parts[-1].count()
        at, step = at + step, 2 * step
    if not parts:
        return read(list(files)).limit(0)
    whole = reduce(DataFrame.unionByName, parts)
    return _quota(whole, n).select(*[c for c in whole.columns if c != "place"])
