"""Similarity join on word shingles: all links with a Jaccard index of 0.8 or more.

Two texts whose shingle sets overlap that much share a shingle among the first fifth
of both, whatever the common order of shingles (prefix filter). Texts meet only by
such a shingle. The order puts frequent shingles last: a table of counters over all
texts, of fixed size, tells which are frequent, so that a line or passage that many
documents share brings hardly any of them together. The order decides how much work
is done, never which links are found. Two texts need to meet only by the first shingle
of that order they share, so a shingle of a single text is not handed on, the places of
a shingle in both texts bound what they can share from there on, and texts that share
the shingle before it too have met already.

Texts that meet are compared in tiles of one size band: sizes must agree within the
threshold; hashed bitmaps of the sets bound the overlap from above by counting bits;
only what is left is decided on the sorted sets themselves. First every text is
compared with a few anchors among those it meets, which joins large groups of near
copies with few comparisons. Then texts that meet but are still in different
components are compared with each other, in blocks, so no group is ever expanded into
all its pairs and no possible connection is left out. Exact copies are linked within
their task and do not take part any further there.

Defined results: see ``shingles`` for words and sets; a text without words and a null
text have an empty set and link with nothing; a null id links with nothing and has no
component; an id that occurs on several rows is one node with the links of all its
rows; an empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import discard, free_name, maybe_broadcast, staged
from lexivane.llm.components import components, merged
from lexivane.llm.exact import attach_groups
from lexivane.llm.shingles import shingle_sets

PERCENT = 80
# Counters of the frequency table; one byte each is broadcast.
CELLS = 1 << 25
BLOCKS = 64
# Share of all shingles that is looked at a second time, and the bits of that look: one for
# each shingle there is, within these bounds (the upper ones take 128 MB).
RARE_SHARE = 0.6
FEWEST_RARE_BITS, MOST_RARE_BITS = 1 << 22, 1 << 30
# Texts of a meeting that all others are compared with first.
ANCHORS = 3
# Prefix entries of one bucket, and entries a task holds before it hands them on.
BUCKET_ENTRIES = 1 << 20
HELD_ENTRIES = 1 << 19
# Shingles of the texts of one tile, links of one text that stay together, and texts
# of a block of the second comparison.
TILE_SHINGLES = 1 << 21
ANCHOR_LINKS = 512
BLOCK_TEXTS = 1024
# Rows of tiles one call compares.
CALL_ROWS = 1 << 15
FEWEST_BITS, MOST_BITS = 256, 16384
NEED_BYTES = 120


def prefix_length(size: int) -> int:
    """How many shingles of a set must be looked at to miss no link."""
    return size - -(-PERCENT * size // 100) + 1


def reach(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The size up to which a text may link with one whose first common shingle is at ``place`` of its order."""
    return (100 + PERCENT) * (size - place) // PERCENT - size


def size_band(size: Column) -> Column:
    """Sizes that may link are in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")


def cell_of(hashes: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


class Seen:
    """Which bits were met, and which more than once: two bitmaps of ``bits`` bits."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64(bits - 1)
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit of each shingle, independent of its counter."""
        bit = hashes & self.mask
        return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at, times = np.unique(hashes & self.mask, return_counts=True)
        byte, bit = self.place(at)
        again = (times > 1) | ((self.once[byte] & bit) > 0)
        np.bitwise_or.at(self.twice, byte[again], bit[again])
        np.bitwise_or.at(self.once, byte, bit)


def bitmap(hashes: np.ndarray) -> bytes:
    """Hashed bits of a set, about two a member, in a power of two."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << int(2 * len(hashes) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps cut to ``width`` bytes by laying their parts over each other."""
    out = np.empty((len(maps), width // 8), "<u8")
    for row, raw in zip(out, maps, strict=True):
        row[:] = np.bitwise_or.reduce(np.frombuffer(raw, "<u8").reshape(-1, width // 8), axis=0)
    return out


def may_link(size_a: np.ndarray, size_b: np.ndarray, differing_bits: np.ndarray) -> np.ndarray:
    """Whether the overlap can reach the threshold: each differing bit is a member that only one set has."""
    overlap = np.minimum(np.minimum(size_a, size_b), (size_a + size_b - differing_bits) // 2)
    return 100 * overlap >= PERCENT * (size_a + size_b - overlap)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Decides on the sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(batch.column(1))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# --- sizes and frequencies -------------------------------------------------------


def _add(cells: np.ndarray, at: np.ndarray) -> None:
    met, times = np.unique(at, return_counts=True)
    cells[met] = np.minimum(cells[met] + times, 255)


def _packed_blocks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for block, part in enumerate(cells.reshape(BLOCKS, -1)):
        if part.any():
            yield block, zlib.compress(part.tobytes(), 1)


def _sizes_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with its size; at the end a row per block of this task's counters."""
    names = ["doc_id", "n_shingles", "block", "counts"]
    cells = np.zeros(CELLS, np.uint8)
    for batch in batches:
        sets = _sets(batch)
        if sets:
            _add(cells, cell_of(np.concatenate(sets)))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        nothing = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *nothing], names=names)
    for block, raw in _packed_blocks(cells):
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([raw], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of a block; classes tell how far a count is from the mean,
    ``held`` how many shingles each class counted."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint8)
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.astype(np.uint64)
    for block, counts in sums.items():
        mean = counts.mean()
        above = (counts - mean) / np.sqrt(mean + 0.25)
        fine, coarse = np.floor(above * 4) + 32, 150 + 8 * np.log2(np.maximum(above, 16) / 16)
        classes = np.clip(np.where(above < 16, np.minimum(fine, 150), coarse), 0, 255).astype(np.uint8)
        held = np.bincount(classes, weights=counts, minlength=256).astype("<f8")
        columns = [[block], [zlib.compress(classes.tobytes(), 1)], [held.tobytes()]]
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "classes", "held"])


def frequency_classes(counted: DataFrame) -> tuple[dict[int, bytes], np.ndarray]:
    """Per block one byte a cell, compressed, the higher the more frequent its shingles; shingles of each class."""
    blocks = counted.filter("block is not null").select("block", "counts").repartition(BLOCKS, "block")
    rows = blocks.mapInArrow(_classes, "block int, classes binary, held binary").collect()
    held = sum((np.frombuffer(row.held, "<f8") for row in rows), np.zeros(256))
    return {row.block: bytes(row.classes) for row in rows}, held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block which bits are set twice in one part, or in two."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            once, twice = (np.frombuffer(zlib.decompress(r), np.uint8) for r in raw)
            if block in sums:
                known = sums[block]
                known[1] |= twice | (known[0] & once)
                known[0] |= once
            else:
                sums[block] = [once.copy(), twice.copy()]
    for block, (_, twice) in sums.items():
        arrays = [pa.array([block], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "twice"])


class Order(NamedTuple):
    """How shingles are ordered: ``classes`` tells for each counter how frequent its shingles
    are (0: rare), ``twice`` which rare ones may occur in several texts."""

    classes: np.ndarray
    twice: np.ndarray


class SharedOrder(NamedTuple):
    """An ``Order`` as broadcasts; the driver holds no table itself."""

    classes: Broadcast
    twice: Broadcast

    def value(self) -> Order:
        return Order(self.classes.value, self.twice.value)

    def destroy(self) -> None:
        self.classes.destroy()
        self.twice.destroy()


def frequency_order(docs: DataFrame, counted: DataFrame, shingles: int) -> SharedOrder:
    """The order of shingles from two looks at all texts.

    A counter adds up all shingles that fall on it. The second look covers rare shingles
    only and asks no more than whether a shingle is alone on its bit, so it has many more
    bits than there are counters and tells most shingles of a single text.
    """
    rough, held = frequency_classes(counted)
    limit = int(np.searchsorted(np.cumsum(held), RARE_SHARE * held.sum()))
    # By a table of 256 and a block at a time, as the driver should hold one copy of all counters, and not for long.
    steps = np.arange(256)
    table = np.minimum(16, np.where(steps <= limit, 0, 2 + (steps - limit) // 8)).astype(np.uint8)
    classes = np.zeros((BLOCKS, CELLS // BLOCKS), np.uint8)
    for block, raw in rough.items():
        classes[block] = table[np.frombuffer(zlib.decompress(raw), np.uint8)]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(classes.reshape(-1))
    del rough, classes
    bits = min(MOST_RARE_BITS, max(FEWEST_RARE_BITS, 1 << shingles.bit_length()))

    def look_at_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = shared.value, Seen(bits)
        for batch in batches:
            sets = _sets(batch)
            if sets:
                hashes = np.concatenate(sets)
                seen.add(hashes[first[cell_of(hashes)] == 0])
        maps = zip(seen.once.reshape(BLOCKS, -1), seen.twice.reshape(BLOCKS, -1), strict=True)
        for block, (once, twice) in enumerate(maps):
            if once.any():
                raw = [pa.array([zlib.compress(m.tobytes(), 1)], pa.binary()) for m in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *raw], names=["block", "once", "twice"])

    again = staged(_texts(docs).mapInArrow(look_at_rare, "block int, once binary, twice binary"), "jaccard-counts")
    twice = np.zeros((BLOCKS, bits // 8 // BLOCKS), np.uint8)
    for row in again.repartition(BLOCKS, "block").mapInArrow(_repeated, "block int, twice binary").collect():
        twice[row.block] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    discard(again)
    return SharedOrder(shared, context.broadcast(twice.reshape(-1)))


def rank_of(hashes: np.ndarray, order: Order) -> np.ndarray:
    """Place of each shingle in the common order; equal places are ordered by hash."""
    classes = order.classes[cell_of(hashes)]
    bit = hashes & np.uint64(8 * len(order.twice) - 1)
    twice = order.twice[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
    return np.where(classes == 0, twice, classes)


# --- meeting by prefix shingles --------------------------------------------------

ENTRIES = "bucket int, keys binary, docs binary, sizes binary, reaches binary, befores binary, doc_id long, copy_of long, n long, bits binary"


def prefix_of(hashes: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the prefix of a set the shingles other texts may have, the sizes they reach, and which one of them is before each (0: none)."""
    ranks = rank_of(hashes, order)
    places = np.argsort(ranks, kind="stable")[: prefix_length(len(hashes))]
    at = np.flatnonzero(ranks[places])
    keys = hashes[places[at]]
    return keys, np.minimum(reach(len(hashes), at), (1 << 31) - 1).astype("<i4"), np.r_[np.zeros(1, "<u8"), keys][: len(keys)]


def prefix_entries(docs: DataFrame, shared: SharedOrder, buckets: int) -> DataFrame:
    """Rows of three kinds: packed entries of a bucket, copies, and one bitmap per text.

    Entries are packed by bucket of their shingle, so the shuffle moves few large rows.
    """
    names = [f.split()[0] for f in ENTRIES.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(columns: dict[str, list]) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(rows, k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def packed(held: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, int]]) -> pa.RecordBatch:
        keys, reaches, befores = (np.concatenate(part) for part in zip(*(e for e, _, _ in held), strict=True))
        lengths = [len(e[0]) for e, _, _ in held]
        ids = np.repeat(np.array([d for _, d, _ in held], "<i8"), lengths)
        sizes = np.repeat(np.array([n for _, _, n in held], "<i4"), lengths)
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: dict[str, list] = {"bucket": [], "keys": [], "docs": [], "sizes": [], "reaches": [], "befores": []}
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            rows["bucket"].append(b)
            for name, values in (("keys", keys), ("docs", ids), ("sizes", sizes), ("reaches", reaches), ("befores", befores)):
                rows[name].append(values[own].tobytes())
        return batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = shared.value(), {}
        held, number = [], 0
        for batch in batches:
            copies: dict[str, list] = {"doc_id": [], "copy_of": []}
            single: dict[str, list] = {"doc_id": [], "n": [], "bits": []}
            for doc_id, hashes in zip(batch.column(0).to_pylist(), _sets(batch), strict=True):
                if doc_id is None or not len(hashes):
                    continue
                same = first.setdefault(xxhash.xxh3_128_digest(hashes), doc_id)
                if same != doc_id:
                    copies["doc_id"].append(doc_id)
                    copies["copy_of"].append(same)
                    continue
                entries = prefix_of(hashes, known)
                if len(entries[0]):
                    held.append((entries, doc_id, len(hashes)))
                    number += len(entries[0])
                for name, value in (("doc_id", doc_id), ("n", len(hashes)), ("bits", bitmap(hashes))):
                    single[name].append(value)
                if number >= HELD_ENTRIES:
                    yield packed(held)
                    held, number = [], 0
            for rows in (copies, single):
                if rows["doc_id"]:
                    yield batch_of(rows)
        if held:
            yield packed(held)

    return _texts(docs).mapInArrow(run, ENTRIES)


MEETINGS = "meeting long, doc_id long, n int"


def _largest(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest of ``values[start:end]`` for many ranges; -1 for empty ones."""
    out = np.full(len(start), -1, np.int64)
    length = end - start
    doubled, step = values, 1
    while (at := np.flatnonzero((length >= step) & (length < 2 * step))).size or (length >= 2 * step).any():
        # ``doubled`` holds the largest of ``step`` values in a row.
        out[at] = np.maximum(doubled[start[at]], doubled[end[at] - step])
        doubled, step = np.maximum(doubled[:-step], doubled[step:]), 2 * step
    return out


def _with_partner(group: np.ndarray, sizes: np.ndarray, reaches: np.ndarray) -> np.ndarray:
    """Which texts another of their group may link with, as both reach the other's size; by group, then by size."""
    own, base = np.arange(len(group)), group << 32
    far = np.searchsorted(base + sizes, base + reaches, side="right")
    first = np.searchsorted(group, group)
    return (_largest(reaches, first, np.minimum(own, far)) >= sizes) | (_largest(reaches, own + 1, np.maximum(own + 1, far)) >= sizes)


def _meetings(table: pa.Table) -> pa.Table:
    """Texts of a bucket that share a shingle and may link by their sizes, named by a hash
    of who meets with which sizes.

    A text that no other one of the shingle may link with is left out. The others fall
    apart where, in the order of sizes, one is larger than any before it reaches: none of
    the smaller ones can link with it or a larger one. Where all share the shingle before
    as well, each two have met by their first common one. Near copies share many shingles;
    the same texts meeting again make the same rows, which are dropped here and, between
    buckets, by the caller.
    """

    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)

    keys, ids, sizes = column("keys", "<u8"), column("docs", "<i8"), column("sizes", "<i4").astype(np.int64)
    known = set(table.column_names)
    reaches = column("reaches", "<i4").astype(np.int64) if "reaches" in known else reach(sizes, np.zeros_like(sizes))
    befores = column("befores", "<u8") if "befores" in known else np.zeros_like(keys)
    order = np.lexsort((ids, sizes, keys))
    keys, ids, sizes, reaches, befores = (c[order] for c in (keys, ids, sizes, reaches, befores))
    group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]][: len(keys)])
    kept = np.flatnonzero(_with_partner(group, sizes, reaches))
    group, ids, sizes, reaches, befores = (c[kept] for c in (group, ids, sizes, reaches, befores))
    reached = np.maximum.accumulate((group << 32) + reaches)
    starts = np.flatnonzero(np.r_[True, reached[:-1] < (group[1:] << 32) + sizes[1:]]) if len(group) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(group)])
    apart = (befores == 0) | (befores != np.repeat(befores[starts], lengths))
    new = np.logical_or.reduceat(apart, starts) if len(starts) else np.empty(0, bool)
    who = np.stack([ids, sizes], axis=1).astype("<i8")
    once = np.r_[True, (who[1:] != who[:-1]).any(axis=1) | (group[1:] != group[:-1])][: len(who)]
    met: dict[int, np.ndarray] = {}
    for a, b in zip(starts[new].tolist(), (starts + lengths)[new].tolist(), strict=True):
        own = np.flatnonzero(once[a:b]) + a
        if len(own) > 1:
            met.setdefault(xxhash.xxh3_64_intdigest(who[own]), own)
    at = np.concatenate(list(met.values())) if met else np.empty(0, np.int64)
    names = np.repeat(np.array(list(met), np.uint64), [len(g) for g in met.values()])
    return pa.table({"meeting": names.view("<i8"), "doc_id": ids[at], "n": sizes[at].astype(np.int32)})


# --- comparing -------------------------------------------------------------------


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of written pairs ``a, b, na, nb`` those that link, written as ``a, b``."""
    total = pairs.count()
    weight = pairs.withColumn("band", size_band(F.greatest("na", "nb")))
    sums = weight.groupBy("band").agg(F.sum(F.col("na") + F.col("nb")).alias("s")).collect()
    if not sums:
        return staged(pairs.select("a", "b"), "jaccard-links")
    tiles = {r.band: max(1, -(-r.s // TILE_SHINGLES)) for r in sums}
    in_band = F.create_map(*[F.lit(x) for item in tiles.items() for x in item])
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / ANCHOR_LINKS)
    spread = F.xxhash64("a", F.pmod(F.xxhash64("b"), parts))
    tiled = staged(
        attach_groups(weight, degrees, "a", total)
        .withColumn("tile", F.concat_ws(":", "band", F.pmod(spread, in_band[F.col("band")])))
        .select("tile", "a", "b"),
        "jaccard-tiles",
    )
    need = tiled.select("tile", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    need = staged(need, "jaccard-need")
    texts = _texts(docs).join(maybe_broadcast(need, need.count(), NEED_BYTES), "doc_id").select("tile", "doc_id", "text")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        places: dict[int, list[int]] = {}
        for place, doc_id in enumerate(right["doc_id"].to_pylist()):
            places.setdefault(doc_id, []).append(place)
        sets: list[np.ndarray] = []
        for batch in right.select(["doc_id", "text"]).to_batches(max_chunksize=512):
            sets += _sets(batch)
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = [bitmap(s) for s in sets]
        found: tuple[list[int], list[int]] = ([], [])
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            if any(_close(sets, sizes, maps, i, j) for i in places.get(a, ()) for j in places.get(b, ())):
                found[0].append(a)
                found[1].append(b)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    found = tiled.groupBy("tile").cogroup(texts.groupBy("tile")).applyInArrow(compare, "a long, b long")
    links = staged(found, "jaccard-links")
    discard(tiled, need)
    return links


def _close(sets: list[np.ndarray], sizes: np.ndarray, maps: list[bytes], i: int, j: int) -> bool:
    if not sizes[i] or not sizes[j]:
        return False
    one, other = folded([maps[i], maps[j]], min(len(maps[i]), len(maps[j])))
    return bool(may_link(sizes[i], sizes[j], np.bitwise_count(one ^ other).sum())) and linked(sets[i], sets[j])


def first_pairs(meetings: DataFrame) -> DataFrame:
    """Each text with a few anchors among those it meets, where sizes allow a link.

    Anchors are the texts of the smallest id and of the smallest hashes of it, so texts
    that meet often have the same ones, and a group of near copies becomes one component
    although not all of it is similar to one anchor.
    """
    orders = [F.col("doc_id"), *[F.xxhash64("doc_id", F.lit(i)) for i in range(1, ANCHORS)]]
    anchors = [F.struct(F.min_by("doc_id", o).alias("other"), F.min_by("n", o).alias("size")) for o in orders]
    chosen = staged(meetings.groupBy("meeting").agg(F.count(F.lit(1)).alias("n"), F.array(*anchors).alias("anchors")), "jaccard-chosen")
    rows = attach_groups(meetings.withColumnRenamed("n", "own"), chosen, "meeting", meetings.count())
    pairs = rows.select("doc_id", "own", F.explode(F.array_distinct("anchors")).alias("anchor"))
    pairs = pairs.select("doc_id", "own", "anchor.*").filter(
        f"other <> doc_id and 100 * least(own, size) >= {PERCENT} * greatest(own, size)"
    )
    first = F.col("doc_id") < F.col("other")
    return pairs.select(
        F.least("doc_id", "other").alias("a"),
        F.greatest("doc_id", "other").alias("b"),
        F.when(first, F.col("own")).otherwise(F.col("size")).alias("na"),
        F.when(first, F.col("size")).otherwise(F.col("own")).alias("nb"),
    ).dropDuplicates(["a", "b"])


TILED = "a long, b long, na int, nb int"


def further_pairs(meetings: DataFrame, labels: DataFrame, bits: DataFrame, best: bool) -> DataFrame:
    """Pairs that meet, may link, and are in different components so far, as ``a, b, na, nb, more``.

    With ``best`` only the likeliest pair of each text in a tile; ``more`` tells whether there
    are others.

    The texts that meet by a shingle are cut into size bands and blocks. A tile is two
    blocks of one band or of neighbouring ones; one holds texts outside the meeting's
    largest component, the other texts outside it or of it. The largest is never laid
    against itself, so what is sent grows with the texts outside it.
    """
    placed = (
        meetings.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .withColumn("band", size_band(F.col("n")))
    )
    spans = staged(meetings_with_several(placed), "jaccard-spans")
    several = attach_groups(placed.withColumnRenamed("n", "size"), spans, "meeting", meetings.count())
    main = (F.col("component") == F.col("largest")).alias("main")
    open_rows = staged(several.filter("n is not null").select(*[c for c in placed.columns if c != "n"], "size", main), "jaccard-open")
    per_band = open_rows.groupBy("meeting", "band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("main")).alias("others"), F.count_if("main").alias("mains")
    )
    numbers = [F.ceil(F.col(c) / BLOCK_TEXTS).cast("int").alias(c) for c in ("others", "mains")]
    blocks = staged(per_band.select("meeting", "band", "n", *numbers), "jaccard-blocks")
    # A text meets its own band and both neighbours.
    above, below = (
        blocks.select("meeting", (F.col("band") - step).alias("band"), F.col("others").alias(f"others_{name}"), F.col("mains").alias(f"mains_{name}"))
        for step, name in ((1, "above"), (-1, "below"))
    )
    sides = blocks.join(above, ["meeting", "band"], "left").join(below, ["meeting", "band"], "left").fillna(0)
    sides = staged(sides.withColumn("where", F.struct("meeting", "band")).drop("meeting", "band"), "jaccard-sides")
    known = attach_groups(open_rows.withColumn("where", F.struct("meeting", "band")), sides, "where", open_rows.count())
    known = known.filter("not main or others + others_above + others_below > 0").join(bits, "doc_id")
    held = F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))
    own = F.pmod(F.xxhash64("doc_id"), held).cast("int")

    def tile(low: Column, high: Column, i: Column, j: Column, whole: int, side: Column) -> Column:
        return F.struct(
            low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), F.lit(whole).alias("whole"), side.alias("side")
        )

    def tiles(number: str, make: Callable[[Column], Column]) -> Column:
        none = F.array().cast("array<struct<low:int,high:int,i:int,j:int,whole:int,side:int>>")
        return F.when(F.col(number) > 0, F.transform(F.sequence(F.lit(0), F.col(number) - 1), lambda x: make(x))).otherwise(none)

    band, left, right = F.col("band"), F.lit(0), F.lit(1)
    steps = (("", 0), ("_above", 1), ("_below", -1))
    of_main = F.concat(*[tiles(f"others{s}", lambda i, d=d: tile(band + d, band, i, own, 1, right)) for s, d in steps])
    of_other = F.concat(
        tiles("others", lambda j: tile(band, band, F.least(own, j), F.greatest(own, j), 0, (own > j).cast("int"))),
        tiles("others_above", lambda j: tile(band, band + 1, own, j, 0, left)),
        tiles("others_below", lambda i: tile(band - 1, band, i, own, 0, right)),
        *[tiles(f"mains{s}", lambda j, d=d: tile(band, band + d, own, j, 1, left)) for s, d in steps],
    )
    sent = F.when(F.col("main"), of_main).otherwise(of_other)
    mixed = F.expr("tile.whole = 1 OR tile.low <> tile.high OR tile.i <> tile.j").alias("mixed")
    spread = known.withColumn("tile", F.explode(sent)).select("meeting", "tile.*", mixed, "doc_id", "size", "component", "bits")

    spread = staged(spread, "jaccard-spread")
    number = max(1, -(-spread.count() // CALL_ROWS))
    tile_id = F.xxhash64("meeting", "low", "high", "i", "j", "whole")
    called = spread.withColumn("tile", tile_id).withColumn("call", F.pmod("tile", F.lit(number)))
    wanted = called.select("call", "tile", "mixed", "side", "doc_id", "size", "component", "bits")
    pairs = _likeliest_cross_pairs if best else _cross_pairs
    found = wanted.groupBy("call").applyInArrow(pairs, f"{TILED}, more boolean")
    once = found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("more").alias("more"))
    once = staged(once, "jaccard-pairs")
    discard(spans, open_rows, blocks, sides, spread)
    return once


def _cross_pairs(table: pa.Table) -> pa.Table:
    return _tile_pairs(table, best=False)


def _likeliest_cross_pairs(table: pa.Table) -> pa.Table:
    return _tile_pairs(table, best=True)


def _tile_pairs(table: pa.Table, best: bool) -> pa.Table:
    """The pairs of all tiles of a call that pass size and bitmap bound.

    With ``best`` of each text of a tile the likeliest pair only; ``more`` tells that the
    call has others.
    """
    table = table.sort_by("tile")
    tile, side, ids, size, component = (
        table[c].to_numpy() for c in ("tile", "side", "doc_id", "size", "component")
    )
    size, mixed, raw = size.astype(np.int64), table["mixed"].to_numpy(), table["bits"].to_pylist()
    edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
    out: list[list[np.ndarray]] = [[], []]
    hidden = False
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        maps = folded(raw[start:end], min(map(len, raw[start:end])))
        everyone = np.arange(start, end)
        left = everyone[side[start:end] == 0] if mixed[start] else everyone
        right = everyone[side[start:end] == 1] if mixed[start] else everyone
        for i in left.tolist():
            other = right if mixed[start] else right[i + 1 - start :]
            other = other[(component[other] != component[i]) & (ids[other] != ids[i])]
            smaller, larger = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            other = other[100 * smaller >= PERCENT * larger]
            if len(other):
                differing = np.bitwise_count(maps[other - start] ^ maps[i - start]).sum(axis=1).astype(np.int64)
                may = may_link(size[other], size[i], differing)
                other, differing = other[may], differing[may]
                if best and len(other) > 1:
                    other, hidden = other[[differing.argmin()]], True
                out[0].append(np.full(len(other), i))
                out[1].append(other)
    one, other = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
    swap = ids[other] < ids[one]
    low, high = np.where(swap, other, one), np.where(swap, one, other)
    _, once = np.unique(np.stack([ids[low], ids[high]]), axis=1, return_index=True)
    low, high = low[once], high[once]
    sizes = size.astype(np.int32)
    more = np.full(len(low), hidden)
    return pa.table({"a": ids[low], "b": ids[high], "na": sizes[low], "nb": sizes[high], "more": more})


def meetings_with_several(placed: DataFrame) -> DataFrame:
    """``meeting, n, largest``: meetings of more than one component, and which has most of the texts."""
    per_component = placed.groupBy("meeting", "component").agg(F.count(F.lit(1)).alias("members"))
    spans = per_component.groupBy("meeting").agg(
        F.sum("members").alias("n"),
        F.count(F.lit(1)).alias("several"),
        F.max_by("component", F.struct("members", "component")).alias("largest"),
    )
    return spans.filter("several > 1").drop("several")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``."""
    counted = staged(_texts(docs).mapInArrow(_sizes_and_counts, "doc_id long, n_shingles long, block int, counts binary"), "jaccard-counts")
    sizes = staged(counted.filter("block is null").select("doc_id", "n_shingles"), "jaccard-sizes")
    sums = sizes.agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("texts")).first()
    entries = (sums.shingles or 0) * (100 - PERCENT) // 100 + sums.texts
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    order = frequency_order(docs, counted, sums.shingles or 0)
    discard(counted)

    rows = staged(prefix_entries(docs, order, buckets), "jaccard-entries")
    order.destroy()
    packed = rows.filter("bucket is not null").select("bucket", "keys", "docs", "sizes", "reaches", "befores")
    met = packed.groupBy("bucket").applyInArrow(_meetings, MEETINGS)
    meetings = staged(met.dropDuplicates(["meeting", "doc_id", "n"]), "jaccard-meetings")
    copies = staged(rows.filter("copy_of is not null").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b")), "jaccard-copies")
    bits = staged(rows.filter("bits is not null").select("doc_id", "bits"), "jaccard-bits")
    discard(rows)

    tried = staged(first_pairs(meetings), "jaccard-pairs")
    links = verified(tried, docs).unionByName(copies)
    tried, labels, best, hidden = tried.select("a", "b"), components(links), True, True
    # A likely pair of each text joins most of what belongs together, in as many rounds as
    # join anything; all pairs are compared of what is still apart then.
    while hidden:
        pairs = further_pairs(meetings, labels, bits, best)
        if pairs.isEmpty():
            break
        hidden = best and not pairs.filter("more").isEmpty()
        untried = staged(pairs.join(tried, ["a", "b"], "left_anti").drop("more"), "jaccard-untried")
        found = verified(untried, docs)
        best = best and not found.isEmpty()
        if not found.isEmpty():
            labels = merged(labels, found)
        tried = tried.unionByName(untried.select("a", "b"))
    labels = labels.withColumnRenamed("node", "doc_id")
    return sizes.join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a text of a smaller id stands for, with all their columns."""
    found = similar_documents(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    name = free_name(docs.columns)
    losers = staged(found.withColumnRenamed("doc_id", name), "jaccard-losers")
    small = maybe_broadcast(losers, losers.count(), NEED_BYTES)
    return docs.join(small, docs["doc_id"] == losers[name], "left_anti")
