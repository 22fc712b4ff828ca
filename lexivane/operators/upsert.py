"""Upsert by paper id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.operators.planning import broadcast_keys, keys_for_join
from lexivane.session import work_dir

ADDRESS = "row_address"
# Codec of staged and stored rows: text takes a good deal less than with Spark's default.
CODEC = "zstd"


def addressed(batch: DataFrame, folder: str | None = None) -> DataFrame:
    """The batch, written with a number for every row that stays the row's own."""
    path = folder or work_dir(batch.sparkSession, "batch")
    rows = batch.withColumn(ADDRESS, F.monotonically_increasing_id())
    rows.write.option("compression", CODEC).parquet(path)
    return batch.sparkSession.read.parquet(path)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Ids and addresses of the rows with their place ``seq`` in the given order.

    One integer column is the place itself. Otherwise the order columns alone are
    sorted; no text is moved.
    """
    if len(order) == 1 and isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return rows.select("paper_id", ADDRESS, F.col(order[0]).cast("bigint").alias("seq"))
    narrow = rows.select("paper_id", ADDRESS, *order)
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("paper_id", ADDRESS, F.monotonically_increasing_id().alias("seq"))


def last_addresses(rows: DataFrame, order: list[str], copies: str = "copies") -> DataFrame:
    """Per id the address of its last row, and how many rows it had.

    A hash aggregation over three numbers: rows of one id are reduced within each task
    before the shuffle, so an id that holds a large part of the batch sends one row a task.
    """
    last = F.max_by(ADDRESS, "seq").alias(ADDRESS)
    return _numbered(rows, order).groupBy("paper_id").agg(last, F.count(F.lit(1)).alias(copies))


def winners(rows: DataFrame, order: list[str], copies: str = "copies") -> DataFrame:
    """``last_addresses`` without the ids."""
    return last_addresses(rows, order, copies).drop("paper_id")


def fetched(rows: DataFrame, order: list[str], chosen: DataFrame, at_most: int) -> DataFrame:
    """The rows of the chosen addresses, of which there are ``at_most``."""
    return rows.drop(*order).join(broadcast_keys(chosen, at_most), ADDRESS).drop(ADDRESS)


def last_per_id(rows: DataFrame, order: list[str], copies: str | None = None) -> DataFrame:
    """One row per id of an ``addressed`` batch: the last in the given order, which must
    tell an id's rows apart.

    The rows are fetched by their addresses, so the texts of the others are never moved.
    ``copies`` names a column for the number of rows an id had.
    """
    chosen = winners(rows, order, copies or "copies")
    kept = fetched(rows, order, chosen, rows.count())
    return kept if copies else kept.drop("copies")


def merge(
    current: DataFrame, batch: DataFrame, written_at, batch_rows: int, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, new): current rows the batch does not touch, and the batch's rows.

    ``batch`` holds ``batch_rows`` rows, one per id; ``ids`` are those, where they are
    at hand. A new row replaces every
    column of a stored one, with null too, but keeps its ``created_at``. Only
    the batch's ids meet the current rows: broadcast while they are few, else dealt by id
    and hashed. Current rows are not shuffled where they are bucketed by id.
    """
    keys = keys_for_join((batch if ids is None else ids).select("paper_id"), batch_rows)
    kept = current.join(keys, "paper_id", "left_anti")
    known = current.select("paper_id", "created_at").join(keys, "paper_id", "left_semi")
    new = (
        batch.drop("created_at")
        .join(keys_for_join(known, batch_rows), "paper_id", "left")
        .withColumn("updated", F.col("created_at").isNotNull())
        .withColumn("created_at", F.coalesce("created_at", F.lit(written_at).cast("timestamp")))
    )
    return kept, new
