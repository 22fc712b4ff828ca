"""Best-two-fit packing of documents into sequences of a fixed length.

Only a piece's length matters for where it goes, and there are at most as many
lengths as a sequence has tokens. So the packing is planned on a histogram of
lengths, whose size does not grow with the data: a sequence is filled greedily with
the longest piece that fits; then its smallest piece is replaced by two unpacked
pieces that together fill the widened gap better, where there are such. The same
fill is repeated as often as the counts allow and noted once. Each piece finds its
place from its length and its rank among the pieces of that length; ranks come from
counts per task, so neither a window over all rows nor a collected group is needed.

Documents that are longer than a sequence are cut from their end into pieces of full
length; the first piece takes what is left. Shorter ones are never cut.

Defined results: a null text counts as empty and has the end id alone; repeated rows
are packed as often as they occur; an empty table gives an empty result. Only the id
and the text column are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import staged
from lexivane.llm.pieces import joined_batches, piece_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Fill:
    """``times`` sequences that hold pieces of these lengths."""

    lengths: tuple[int, ...]
    times: int


def plan_fills(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Best-two-fit over a histogram of lengths (all from 1 to ``capacity``)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    fills = []
    while left.any():
        chosen = _greedy(left, capacity)
        chosen = _two_for_smallest(left, chosen, capacity)
        lengths, needed = np.unique(chosen, return_counts=True)
        times = int((left[lengths] // needed).min())
        left[lengths] -= times * needed
        fills.append(Fill(tuple(sorted(chosen, reverse=True)), times))
    return fills


def _greedy(left: np.ndarray, capacity: int) -> list[int]:
    chosen, gap, limit = [], capacity, capacity
    while gap:
        there = np.flatnonzero(left[1 : min(gap, limit) + 1])
        if not len(there):
            break
        length = int(there[-1]) + 1
        copies = min(gap // length, int(left[length]))
        chosen += [length] * copies
        gap -= copies * length
        limit = length - 1
    return chosen


def _two_for_smallest(left: np.ndarray, chosen: list[int], capacity: int) -> list[int]:
    gap = capacity - sum(chosen)
    if not gap or len(chosen) < 2:
        return chosen
    smallest = chosen[-1]
    room = gap + smallest
    free = left.copy()
    np.subtract.at(free, chosen, 1)
    free[smallest] = 0  # taken out, and no member of a pair that is to replace it
    there = np.flatnonzero(free[1 : room + 1]) + 1
    if not len(there):
        return chosen
    # For each first length the longest second one that still fits beside it.
    partner = np.searchsorted(there, room - there, "right") - 1
    partner = np.minimum(partner, np.arange(len(there)))
    alone = (partner == np.arange(len(there))) & (free[there] < 2)
    partner = np.where(alone, partner - 1, partner)
    total = np.where(partner >= 0, there + there[np.maximum(partner, 0)], 0)
    best = int(total.argmax())
    if total[best] <= smallest:
        return chosen
    return [*chosen[:-1], int(there[best]), int(there[partner[best]])]


def slots(fills: list[Fill]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """Per length the first ranks of its runs, and ``first, sequence, copies, offset`` of each."""
    found: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for fill in fills:
        lengths, copies = np.unique(fill.lengths, return_counts=True)
        offset = 0
        for length, several in zip(lengths[::-1].tolist(), copies[::-1].tolist(), strict=True):
            first = taken.get(length, 0)
            firsts, runs = found.setdefault(length, ([], []))
            firsts.append(first)
            runs.append((first, sequence, several, offset))
            taken[length] = first + several * fill.times
            offset += several * length
        sequence += fill.times
    return found


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document."""
    first = tokens % capacity or capacity
    edges = [0, *range(first, tokens + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Every document encoded, closed with ``end_id`` and cut; ``rank`` counts equal lengths of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), {}
        encoder = piece_encoder(path)
        end = np.array([end_id], "<u4")
        for batch in joined_batches(batches, 1):
            rows = []
            encoded = encoder.encode(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    rank = met.get(length, 0)
                    met[length] = rank + 1
                    crc = zlib.crc32(ids[start : start + length])
                    rows.append((doc_id, number, start, length, crc, part, rank))
            yield _batch(rows, PIECES)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece."""
    cut_up = staged(pieces(docs, path, end_id, capacity), "pack-pieces")
    per_task = staged(cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # At most ``capacity`` rows.
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = cut_up.sparkSession.sparkContext.broadcast(slots(plan_fills(counts, capacity)))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first_ranks = per_task.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank")
    )
    ranked = cut_up.join(first_ranks, ["length", "part"]).select(
        *[c for c in cut_up.columns if c != "rank"], (F.col("rank") + F.col("first_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            ranks = batch.column(batch.schema.get_field_index("rank")).to_pylist()
            sequences, offsets = [], []
            for length, rank in zip(columns[3].to_pylist(), ranks, strict=True):
                firsts, runs = known[length]
                first, sequence, several, offset = runs[bisect_right(firsts, rank) - 1]
                nth, copy = divmod(rank - first, several)
                sequences.append(sequence + nth)
                offsets.append(offset + copy * length)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PLACED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )
