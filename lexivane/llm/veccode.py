"""Vector codes: each vector cut into parts, each part coded by the nearest entry of a codebook.

Codebooks start from the vectors of the smallest ids and are refined in rounds: parts are
assigned to their nearest entry, entries become the means of their parts. All numbers are
integers, so distances, means and ties are exact and the result does not depend on the
order of rows or on how they are spread.

Assignment is LAESA: every part position has a few fixed pivots, the first entries of its
first codebook, and the distances of all parts to them are computed once and written next
to the vectors. In a round only pivot-to-entry distances are new. The largest difference
|d(part, pivot) - d(pivot, entry)| is a lower bound for d(part, entry); entries are tried in
the order of their bounds, and those whose bound lies above the best distance so far are
never evaluated. Bounds are floating, with a margin; what they let pass is measured in
integers, ties go to the lower entry, so pruning changes nothing.

A round is one pass over the written parts; each task hands on sums and counts per entry,
at most ``parts * entries`` rows, which Spark adds up.

Defined results: vectors that are null, or hold a null or a number that is not finite, are
dropped, and so are those whose length is not that of the kept vector of the smallest id
(ids first, then the numbers; null ids last) or is not a multiple of ``parts``; numbers
beyond ``LIMIT`` count as ``LIMIT``, so that sums fit 64 bits; rows that repeat an id are
vectors of their own, and seeds each; fewer vectors than ``entries`` make smaller
codebooks; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.common import staged
from lexivane.llm.exact import attach_groups

# Largest integer a component becomes, either way: eight squared differences fit 64 bits.
LIMIT = 1 << 28
# Relative error allowed for in a floating distance, far above what it is.
MARGIN = 1e-9
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    pivots: int = 4


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, label, numbers``: kept vectors as integers, in vectors of one length."""
    numbers = F.col("embedding")
    number = F.col("embedding").cast("array<double>")
    sound = numbers.isNotNull() & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), number.alias("raw"))


def whole_numbers(raw: DataFrame, scale: int) -> DataFrame:
    def whole(x):
        return F.greatest(F.least(F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * scale), F.lit(LIMIT)), F.lit(-LIMIT))

    return raw.select("vec_id", "label", F.transform("raw", whole).cast("array<long>").alias("numbers"))


def seeds(vectors: DataFrame, number: int) -> np.ndarray:
    """The vectors of the smallest ids, a row each; at most ``number`` reach the driver."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(number).select("numbers").collect()
    return np.array([r.numbers for r in first], np.int64)


def matrix(numbers: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(numbers).to_numpy()
    return flat.reshape(len(numbers), -1) if len(numbers) else flat.reshape(0, 1)


def in_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    """part x vector x component."""
    return np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, in floating point."""
    return np.sqrt(((a[:, None, :].astype(np.float64) - b[None, :, :]) ** 2).sum(axis=2))


def nearest_entries(part: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its entry and squared distance, and how many distances were measured.

    ``to_pivots`` holds the distances of the rows to ``pivots``.
    """
    from_pivots = lengths(pivots, book)
    bound = np.zeros((len(part), len(book)))
    for pivot in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, pivot, None] - from_pivots[pivot]), out=bound)
    slack = MARGIN * (to_pivots.max(axis=1, initial=0.0) + from_pivots.max(initial=0.0) + 1.0)
    bound = np.maximum(bound - slack[:, None], 0.0) ** 2 * (1 - MARGIN)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(part), np.iinfo(np.int64).max)
    entry = np.full(len(part), len(book))
    rows, measured = np.arange(len(part)), 0
    for step in range(len(book)):
        tried = order[rows, step]
        # Bounds only rise from here: a row whose next one lies above its best is done.
        open_rows = bound[rows, tried] <= best[rows]
        rows, tried = rows[open_rows], tried[open_rows]
        if not len(rows):
            break
        measured += len(rows)
        apart = part[rows] - book[tried]
        squared = np.einsum("ij,ij->i", apart, apart)
        better = (squared < best[rows]) | ((squared == best[rows]) & (tried < entry[rows]))
        best[rows[better]], entry[rows[better]] = squared[better], tried[better]
    return entry, best, measured


class Codebooks:
    """Entries of every part position, and the pivots that never change."""

    def __init__(self, first: np.ndarray, settings: Settings):
        self.settings = settings
        self.books = in_parts(first, settings.parts)
        self.pivots = self.books[:, : settings.pivots].copy()

    def distances_to_pivots(self, rows: np.ndarray) -> np.ndarray:
        """vector x (part, pivot), flat."""
        parts = in_parts(rows, self.settings.parts)
        each = [lengths(part, pivots) for part, pivots in zip(parts, self.pivots, strict=True)]
        return np.stack(each, axis=1).reshape(len(rows), -1)

    def assign(self, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of every part (vector x part), and how many distances it took."""
        parts, own = in_parts(rows, self.settings.parts), to_pivots.reshape(len(rows), self.settings.parts, -1)
        found = [
            nearest_entries(part, own[:, i], pivots, book)
            for i, (part, pivots, book) in enumerate(zip(parts, self.pivots, self.books, strict=True))
        ]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), sum(f[2] for f in found)

    def moved(self, sums: list) -> Codebooks:
        """Entries replaced by the floor of their parts' mean; rows are part, entry, held, sums."""
        after = Codebooks.__new__(Codebooks)
        after.settings, after.pivots, after.books = self.settings, self.pivots, self.books.copy()
        for row in sums:
            after.books[row.part, row.entry] = [int(s) // row.held for s in row.sums]
        return after

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def list_column(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def with_pivot_distances(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` and, next to each, its parts' distances to the pivots."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            measured = books.distances_to_pivots(matrix(batch.column("numbers")))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(measured)], names=[*batch.schema.names, "to_pivots"])

    return vectors.mapInArrow(run, schema)


def _partial_sums(books: Codebooks) -> Callable:
    shape = books.books.shape
    names = ["part", "entry", "held", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for batch in _slices(batches):
            rows = matrix(batch.column("numbers"))
            entry, _, _ = books.assign(rows, matrix(batch.column("to_pivots")))
            for part, values in enumerate(in_parts(rows, shape[0])):
                held[part] += np.bincount(entry[:, part], minlength=shape[1])
                added = np.zeros(shape[1:], np.int64)
                np.add.at(added, entry[:, part], values)
                sums[part] += added
        part, entry = np.nonzero(held)
        if len(part):
            # As text, as a task may add up more than 64 bits hold.
            values = [[str(x) for x in sums[p, e]] for p, e in zip(part, entry, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(held[part, entry]), pa.array(values, pa.list_(pa.string()))],
                names=names,
            )

    return run


def refined(written: DataFrame, books: Codebooks) -> Codebooks:
    """One round: what is collected is one row per part position and entry."""
    width = books.books.shape[2]
    each = written.mapInArrow(_partial_sums(books), "part int, entry int, held long, sums array<string>")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    whole = each.groupBy("part", "entry").agg(F.sum("held").alias("held"), F.array(*totals).alias("sums"))
    return books.moved(whole.collect())


def fit(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Codebooks]:
    """The written vectors with their pivot distances, and the codebooks after all rounds."""
    books = Codebooks(seeds(vectors, settings.entries), settings)
    written = staged(with_pivot_distances(vectors, books), "codes-vectors")
    for _ in range(settings.rounds):
        books = refined(written, books)
    return written, books


def coded(written: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error``; a code is two hexadecimal digits a part."""
    spelled = np.array([f"{i:02x}" for i in range(max(256, books.books.shape[1]))])
    label = written.schema["label"]
    schema = T.StructType([written.schema["vec_id"], label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            entry, squared, _ = books.assign(matrix(batch.column("numbers")), matrix(batch.column("to_pivots")))
            codes = ["".join(row) for row in spelled[entry].tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(squared.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return written.mapInArrow(run, schema)


def vector_codes(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per kept row of ``table``."""
    raw = usable(table)
    vectors = staged(whole_numbers(raw, settings.scale), "codes-numbers")
    least = seeds(vectors.filter("size(numbers) > 0"), 1)
    width = least.shape[1] if len(least) else 0
    same = vectors.filter((F.size("numbers") == width) & F.lit(width > 0 and width % settings.parts == 0))
    if same.isEmpty():
        none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return table.sparkSession.createDataFrame([], none)
    written, books = fit(same, settings)
    rows = staged(coded(written, books).withColumn("group", F.struct("label")), "codes-coded")
    sums = rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    whole = attach_groups(rows, sums, "group", rows.count())
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
