"""Small aids that keep plans the way they are meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 << 20
# What an id with a few numbers takes: at most 64 characters, and row overhead.
KEY_ROW_BYTES = 160


def fits_broadcast(rows: int) -> bool:
    """Whether so many ids with a few numbers may be broadcast."""
    return rows * KEY_ROW_BYTES <= BROADCAST_BYTES


def broadcast_keys(keys: DataFrame, at_most: int) -> DataFrame:
    """Marks a narrow table of at most ``at_most`` rows for broadcast if that fits.

    The mark keeps the other side, the corpus, from being shuffled. Beyond the
    bound Spark is left to join by shuffle.
    """
    return F.broadcast(keys) if fits_broadcast(at_most) else keys


def keys_for_join(keys: DataFrame, at_most: int) -> DataFrame:
    """``broadcast_keys``, or beyond its bound the side that is hashed, task by task: the
    other side, which may be much larger, is not sorted."""
    marked = broadcast_keys(keys, at_most)
    return marked if marked is not keys else keys.hint("shuffle_hash")


def with_column_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that later filters use without computing it again.

    Filters on a plain projected column are pushed below the projection with the
    whole expression copied into them, once per mention. They are not pushed
    through a generator, so the column goes through one.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))
