"""SimHash near-duplicates: fingerprints of texts and their links at a few differing bits.

A fingerprint bit is 1 when it is set in more than half of the hashes of a text's word
shingles, repeats included. Two fingerprints link when at most ``distance`` bits differ.

Fingerprints are cut into so few segments (three for four bits) that of any two that link
one segment differs in one bit at most. Every segment is indexed under its deletion
variants: itself, and itself with one bit taken out, once for each bit. Fingerprints that
link share a variant, meet by equality and are then verified bit by bit. A variant that
more than ``most`` fingerprints hold is cut further: what may still differ in the other
bits is known, so these are cut into one piece more than that, one of which must be
equal, as often as it takes. No candidate is dropped, and no group is expanded into
pairs outside its task: a task hands on one row per fingerprint that is connected.

Equal fingerprints are one class from the start, so copies cost nothing. Results:
a null text counts as empty; a text without words has fingerprint zero and links like any
other; rows that repeat an id are judged each by its own text; a null id belongs to the
component of its text and is never its name, so a component of null ids only has none; an
empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import maybe_broadcast, staged
from lexivane.llm.components import components
from lexivane.llm.exact import attach_groups
from lexivane.llm.shinglehash import shingle_spans, words_of, xxh64_spans
from lexivane.llm.shingles import mixed

BITS = 64
# Entries of one partition, and entries a task looks at together.
PARTITION_ENTRIES = 1 << 21
LOOK_ENTRIES = 1 << 18
KEY_BYTES = 40
# Hashes added up byte by byte before a byte could run over.
ADDED = 255
EACH_BYTE = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Settings:
    words: int = 4
    seed: int = 42
    distance: int = 4
    # Fingerprints of one variant that are laid against each other.
    most: int = 1024

    @property
    def segments(self) -> list[tuple[int, int]]:
        """Lowest bit and width of each segment: of as few as leave one with one differing bit at most."""
        number = self.distance // 2 + 1
        edges = [BITS - BITS * i // number for i in range(number, -1, -1)]
        return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


# --- fingerprints ----------------------------------------------------------------


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; ``counts`` says how many hashes each has."""
    prints = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return prints
    ends = np.cumsum(counts[some])
    starts = ends - counts[some]
    pieces = -(-counts[some] // ADDED)
    of = np.repeat(np.arange(len(some)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = starts[of] + ADDED * (np.arange(len(of)) - first[of])
    over = np.empty((len(some), 8, 8), np.uint8)
    for bit in range(8):
        # Eight bits of a hash at a time, one in each byte of a sum.
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & EACH_BYTE, cuts)
        set_bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over[:, :, bit] = 2 * set_bits > counts[some][:, None]
    prints[some] = np.packbits(over.reshape(len(some), BITS), axis=1, bitorder="little").view("<u8")[:, 0]
    return prints


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, print``: the fingerprint as a signed number, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(1))
            start, length, counts = shingle_spans(words, settings.words)
            prints = majority(xxh64_spans(words.buffer, start, length, settings.seed), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, print long")


def as_hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- variants --------------------------------------------------------------------

# ``bit``: the value of the bit taken out, or -1; ``rest``: bits that are not yet known to
# be equal; ``may``: how many of them may differ.
ENTRIES = "key long, bit byte, print long, rest long, may byte"


def _batch(key, bit, prints, rest, may) -> pa.RecordBatch:
    columns = [key.view(np.int64), bit.astype(np.int8), prints.view(np.int64), rest.view(np.int64), may.astype(np.int8)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "bit", "print", "rest", "may"])


def exact_key(segment: int, value: np.ndarray) -> np.ndarray:
    return value | np.uint64(segment << 58)


def variant_keys(segment: int, width: int, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of a segment's variants and the bit each leaves out (-1 for none)."""
    yield exact_key(segment, value), np.full(len(value), -1)
    for place in range(width):
        bit = (value >> np.uint64(place)) & np.uint64(1)
        yield exact_key(segment, value & ~np.uint64(1 << place)) | np.uint64((place + 1) << 52), bit.astype(np.int8)


def _variants(settings: Settings) -> Callable:
    whole = (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for segment, (low, width) in enumerate(settings.segments):
                mask = ((1 << width) - 1) << low
                value = (prints & np.uint64(mask)) >> np.uint64(low)
                rest = np.full(len(prints), whole ^ mask, np.uint64)
                for key, bit in variant_keys(segment, width, value):
                    yield _batch(key, bit, prints, rest, np.where(bit < 0, settings.distance, settings.distance - 1))

    return run


def crowded_variants(classes: DataFrame, settings: Settings) -> DataFrame:
    """``key`` of every variant that may be held by more than ``most`` fingerprints.

    Counted on the segments: a variant stands for two values of one, so it is crowded only
    where one of them has half as many.
    """
    segments = settings.segments

    def value(segment: int):
        low, width = segments[segment]
        # Shifted without sign, cut to width, numbered as ``exact_key`` does.
        cut = F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1))
        return cut.bitwiseOR(F.lit(segment << 58))

    keys = classes.select(F.explode(F.array(*map(value, range(len(segments))))).alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > settings.most // 2)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for segment, (_, width) in enumerate(segments):
                value = keys[keys >> np.uint64(58) == segment] & np.uint64((1 << 52) - 1)
                for key, _ in variant_keys(segment, width, value):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return crowded.select("key").mapInArrow(expand, "key long").distinct()


def pieces_of(rest: int, number: int) -> list[int]:
    """The set bits of ``rest`` in ``number`` masks of nearly equal size."""
    places = [i for i in range(BITS) if rest >> i & 1]
    edges = [len(places) * i // number for i in range(number + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entry once per piece of its open bits, named by what it was and the piece's value."""
    for batch in batches:
        key, bit, prints, rest, may = (batch.column(i).to_numpy() for i in range(5))
        key, prints, rest = (x.view(np.uint64) for x in (key, prints, rest))
        for one_rest, one_may in sorted(set(zip(rest.tolist(), may.tolist(), strict=True))):
            own = np.flatnonzero((rest == one_rest) & (may == one_may))
            for piece in pieces_of(one_rest, one_may + 1):
                named = mixed(mixed(key[own] ^ np.uint64(piece)) + (prints[own] & np.uint64(piece)))
                yield _batch(named, bit[own], prints[own], rest[own] & ~np.uint64(piece), may[own])


def splittable(may: str = "may", rest: str = "rest") -> str:
    return f"bit_count({rest}) > {may}"


# --- links -----------------------------------------------------------------------


def linked_pairs(key: np.ndarray, bit: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries that share a key and link; ``key`` is sorted.

    Where a bit was taken out, only entries that differ in it are paired: the others are
    by the variant that takes out none.
    """
    places, step, found = np.arange(len(key)), 1, ([], [])
    while len(places := places[: np.searchsorted(places, len(key) - step)]):
        places = places[key[places] == key[places + step]]
        near = np.bitwise_count(prints[places] ^ prints[places + step]) <= distance
        near &= (bit[places] < 0) | (bit[places] != bit[places + step])
        found[0].append(places[near])
        found[1].append(places[near] + step)
        step += 1
    return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per value that is connected to a smaller one: itself and its smallest."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[one], label[other])
        lower = label.copy()
        np.minimum.at(lower, one, least)
        np.minimum.at(lower, other, least)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _links(distance: int) -> Callable:
    def found(table: pa.Table) -> pa.RecordBatch:
        key, bit, prints = (table.column(i).to_numpy() for i in range(3))
        a, b = linked_pairs(key, bit, prints.view(np.uint64), distance)
        one, other = joined(prints[a], prints[b])
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries come sorted by key; the last key of what is held waits for the next batch."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LOOK_ENTRIES:
                table = pa.Table.from_batches(held)
                key = table.column(0).to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                yield found(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _met(entries: DataFrame, number: int, distance: int) -> DataFrame:
    """Links among the entries of each key."""
    session = entries.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), number // PARTITION_ENTRIES)
    # A task gets its keys one after the other from Spark's sort, which spills.
    dealt = entries.select("key", "bit", "print").repartition(parts, "key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(_links(distance), "a long, b long")


def links(classes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``a, b``: pairs of fingerprints from which all links follow (column ``print``, distinct)."""
    entries = classes.select("print").mapInArrow(_variants(settings), ENTRIES)
    number = classes.count() * sum(width + 1 for _, width in settings.segments)
    crowded = staged(crowded_variants(classes, settings), "simhash-crowded")
    found = []
    while held := crowded.count():
        wanted = maybe_broadcast(crowded, held, KEY_BYTES)
        found.append(_met(entries.join(wanted, "key", "left_anti"), number, settings.distance))
        narrowed = entries.join(wanted, "key", "left_semi").mapInArrow(_narrowed, ENTRIES)
        entries = staged(narrowed, "simhash-entries")
        number = entries.count()
        sizes = entries.filter(splittable()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        crowded = staged(sizes.filter(F.col("n") > settings.most).select("key"), "simhash-crowded")
    whole = _met(entries, number, settings.distance)
    for part in found:
        whole = whole.unionByName(part)
    return whole


def similar_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``; the fingerprint in hexadecimal."""
    prints = staged(fingerprints(docs, settings), "simhash-prints")
    grouped = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = staged(grouped, "simhash-classes")
    labels = components(staged(links(classes, settings), "simhash-links"))
    label = F.coalesce("component", "print")
    placed = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", label)
    placed = staged(placed, "simhash-placed")
    # A component of many texts is one row here; texts of one print are attached in the same way.
    roots = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach_groups(placed.select("print", "component", F.col("n").alias("texts")), roots, "component", classes.count())
    by_print = named.select("print", "component_id", F.col("texts").alias("n"))
    whole = attach_groups(prints, by_print, "print", prints.count())
    return whole.select("doc_id", as_hex("print").alias("fingerprint"), "component_id")
