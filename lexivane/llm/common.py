"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.session import work_dir

# A side is broadcast only when its rows are counted and fit this many bytes.
BROADCAST_BYTES = 32 << 20
# What one Arrow batch may carry, so that long texts do not fill a worker.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session.

    Workers import this package: where it is not installed, they look beside this copy
    of it (a cluster gets it by ``--py-files``).
    """
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


_holder: list[tuple[str, Callable[[], None]]] = []


def hold_cache(owner: str, clear: Callable[[], None]) -> None:
    """Called by whoever is about to fill a cache of this process: the last one's is cleared.

    Workers live on between the stages of a job; without this each would keep the caches
    of all operators it ever ran. What Arrow and the C library keep for later is given
    back, too.
    """
    if _holder and _holder[0][0] != owner:
        _holder[0][1]()
        give_back()
    _holder[:] = [(owner, clear)]


def give_back() -> None:
    """What Python, Arrow and the C library keep for later goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """``texts`` in runs of at most ``most_bytes``; a longer text is one alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
        yield texts[start:stop]
        start = stop


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read back.

    What is read back has no lineage beyond the files, so a lost executor costs
    a re-read only, and values such as generated row numbers stay as written.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``staged`` wrote, once everything made from it is written itself."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks ``df`` for broadcast when ``rows`` counted rows are small enough."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))



def free_name(columns: list[str], name: str = "own") -> str:
    """A column name like ``name`` that none of ``columns`` has, whatever its case."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name
