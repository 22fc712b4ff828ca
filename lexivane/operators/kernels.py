"""Arrow batch functions that run inside Spark tasks.

Each one is a closure over plain values, pickled by value, so executors need
only numpy and pyarrow. Memory per task is bounded: rows are worked on in
slices whose score matrix holds at most ``CELLS`` entries, and texts in slices of
``TEXT_BYTES``, whatever the size of the batches that Spark hands over.
"""

from __future__ import annotations

import hashlib
import io
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

CELLS = 1 << 22
# Text that is split into words at a time; the words take some twenty times as much.
TEXT_BYTES = 1 << 21
# Words an embedder remembers from slice to slice, and the longest of them.
CACHED_WORDS, CACHED_WORD_BYTES = 1 << 17, 64
CACHED_CELLS = 1 << 16
WORD_BITS = 32


# --- embedding -------------------------------------------------------------


def word_embedder(dim: int) -> Callable[[pa.Array], pa.Array]:
    """Hashed words: each word adds +1 or -1 to one of ``dim`` cells.

    A word is a run of letters and digits, lower-cased. The first eight hex
    digits of its md5 choose the cell, the parity of the ninth the sign. The
    result has unit length; a text without words has no vector.
    """

    places = word_places(dim)

    def embed(texts: pa.Array) -> pa.Array:
        unit = np.empty((len(texts), dim), dtype=np.float32)
        empty = np.empty(len(texts), dtype=bool)
        for at, upto in text_slices(texts, max(1, CELLS // dim)):
            weights = np.zeros((upto - at, dim))
            for part in text_parts(texts.slice(at, upto - at)):
                add_words(weights, part)
            unit[at:upto], empty[at:upto] = unit_rows(weights)
        return list_array(unit, empty)

    def add_words(weights: np.ndarray, texts: pa.Array) -> None:
        words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
        row = pc.list_parent_indices(words).to_numpy()
        coded = pc.list_flatten(words).dictionary_encode()
        place = places(coded.dictionary)
        cell, sign = place >> 1, 1.0 - 2.0 * (place & 1)
        # Splitting leaves empty strings at the ends of a text.
        sign[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False).astype(bool)] = 0.0
        code = coded.indices.to_numpy()
        cells = row.astype(np.int64) * dim + cell[code]
        weights += np.bincount(cells, weights=sign[code], minlength=weights.size).reshape(weights.shape)

    return embed


def word_places(dim: int) -> Callable[[pa.Array], np.ndarray]:
    """By word twice its cell, and one more where it subtracts.

    The first words met are remembered, as slices share most of theirs.
    """
    known: tuple[pa.Array, np.ndarray] | None = None

    def hashed(words: pa.Array) -> np.ndarray:
        digests = b"".join([hashlib.md5(word).digest() for word in words.cast(pa.binary()).to_pylist()])
        digests = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
        cell = digests[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dim
        return cell * 2 + (digests[:, 4] >> 4 & 1)

    def places(words: pa.Array) -> np.ndarray:
        nonlocal known
        kept, place_of = known or (words[:0], np.zeros(0, dtype=np.int64))
        at = pc.index_in(words, value_set=kept)
        met = at.is_valid().to_numpy(zero_copy_only=False)
        place = np.empty(len(words), dtype=np.int64)
        place[met] = place_of[at.drop_null().to_numpy()]
        new = words.filter(pa.array(~met))
        place[~met] = hashed(new)
        room = CACHED_WORDS - len(kept)
        if room > 0:
            short = pc.less_equal(pc.binary_length(new), CACHED_WORD_BYTES).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(short)[:room]
            known = pa.concat_arrays([kept, new.take(pa.array(some))]), np.concatenate([place_of, place[~met][some]])
        return place

    return places


def text_slices(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """Slices of at most ``rows`` texts that hold ``TEXT_BYTES`` together, or one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        room = TEXT_BYTES + (int(upto[at - 1]) if at else 0)
        end = min(max(int(np.searchsorted(upto, room, side="right")), at + 1), at + rows)
        yield at, end
        at = end


def text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts as they are; one that is longer than ``TEXT_BYTES`` in parts, cut at spaces."""
    if len(texts) > 1 or not texts[0].is_valid or len(texts[0].as_buffer()) <= TEXT_BYTES:
        yield texts
        return
    whole, at = texts[0].as_buffer().to_pybytes(), 0
    while at < len(whole):
        cut = whole.find(b" ", at + TEXT_BYTES)
        end = cut if cut >= 0 else len(whole)
        yield pa.array([whole[at:end]], pa.binary()).cast(texts.type)
        at = end


def unit_rows(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((weights * weights).sum(axis=1))
    empty = size == 0
    return (weights / np.where(empty, 1.0, size)[:, None]).astype(np.float32), empty


def list_array(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    flat = pa.array(np.ascontiguousarray(values).reshape(-1))
    mask = None if missing is None else pa.array(missing)
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def as_matrix(
    vectors: pa.Array, width: int, dtype: type | None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as a matrix, and their positions in the batch."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if len(at) < len(vectors):
        vectors = vectors.take(pa.array(at))
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return flat.astype(dtype or flat.dtype, copy=False).reshape(len(at), width), at


# --- sign codes --------------------------------------------------------------


@lru_cache(maxsize=8)
def planes(bits: int, dim: int) -> np.ndarray:
    """Plane ``j`` has +1 or -1 at ``i`` by the parity of the first hex digit of md5('j:i')."""
    cells = [
        1 - 2 * (int(hashlib.md5(f"{j}:{i}".encode()).hexdigest()[0], 16) & 1)
        for j in range(bits)
        for i in range(dim)
    ]
    return np.array(cells, dtype=np.int8).reshape(bits, dim)


def sign_coder(bits: int, dim: int) -> Callable[[pa.Array], pa.Array]:
    """The side of each plane a vector lies on, 32 bits to a word, bit j of word j // 32."""
    normals = planes(bits, dim).T
    powers = 1 << np.arange(WORD_BITS, dtype=np.int64)

    def code(vectors: pa.Array) -> pa.Array:
        words = np.zeros((len(vectors), bits // WORD_BITS), dtype=np.int64)
        missing = np.ones(len(vectors), dtype=bool)
        matrix, at = as_matrix(vectors, dim, None)
        rows = max(1, CELLS // max(bits, dim))
        for start in range(0, len(at), rows):
            part = matrix[start : start + rows].astype(np.float64)
            above = (part @ normals.astype(np.float64) > 0).reshape(len(part), -1, WORD_BITS)
            words[at[start : start + rows]] = (above * powers).sum(axis=2)
        missing[at] = np.isnan(matrix).any(axis=1) | ~matrix.any(axis=1)
        return list_array(words, missing)

    return code


# --- nearest rows of a block of queries ---------------------------------------


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """In double precision; a zero vector becomes NaN."""
    rows = vectors.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
    return rows


def row_distances(a: np.ndarray, row: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - a[row] . b[q] for lists of row numbers."""
    step = max(1, CELLS // a.shape[1])
    parts = [
        np.einsum("ij,ij->i", a[row[at : at + step]], b[q[at : at + step]])
        for at in range(0, len(row), step)
    ]
    return 1.0 - np.concatenate([np.zeros(0), *parts])


def cosine_scorer(queries: np.ndarray) -> tuple[float, Callable]:
    """Distances in single precision, exact ones for the pairs asked for.

    The first number bounds how far the two lie apart.
    """
    queries = unit_vectors(queries)
    rough_queries = queries.T.astype(np.float32)
    width = queries.shape[1]

    def score(vectors: np.ndarray) -> tuple[np.ndarray, Callable]:
        rows = unit_vectors(vectors)
        rough = rows.astype(np.float32) @ rough_queries
        np.subtract(1, rough, out=rough)
        return rough, lambda row, q: row_distances(rows, row, queries, q)

    return (width + 8) * 2.0**-23 + 1e-9, score


def screening(screen: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """rows x queries: whether a row is to be measured for a query.

    It is where the row's band is ``opened`` for the query, and where the band is ``near``
    and the codes differ in ``bound`` bits at most.
    """
    packed = pack_words(screen["codes"])
    columns = np.ascontiguousarray(packed.T)
    opened, near = (np.ascontiguousarray(screen[name].T) for name in ("opened", "near"))
    bound = screen["bound"]

    def wanted(bands: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = opened[bands]
        rows = pack_words(codes)
        # A few rows at a time, so that what one word leaves fits the processor's cache.
        step = max(1, CACHED_CELLS // len(packed))
        for at in range(0, len(rows), step):
            part, close = rows[at : at + step], near[bands[at : at + step]]
            if close.any():
                total = np.zeros((len(part), len(packed)), dtype=np.uint16)
                for word in range(packed.shape[1]):
                    total += np.bitwise_count(part[:, word, None] ^ columns[word])
                out[at : at + step] |= close & (total <= bound)
        return out

    return wanted


def pack_words(words: np.ndarray) -> np.ndarray:
    """32-bit words, two to a 64-bit word."""
    words = words.astype(np.uint64)
    if words.shape[1] % 2:
        words = np.concatenate([words, np.zeros((len(words), 1), dtype=np.uint64)], axis=1)
    return words[:, 0::2] | (words[:, 1::2] << np.uint64(WORD_BITS))


def masks(passes: pa.ChunkedArray, at: np.ndarray, filters: int) -> np.ndarray | None:
    """rows x filters, or None when nothing filters."""
    if not filters:
        return None
    flags = pc.list_flatten(passes).combine_chunks().to_numpy(zero_copy_only=False)
    return flags.reshape(-1, filters)[at]


class Best:
    """The best rows so far of every query, and the bounds they set.

    ``limit`` is a key no further row may exceed. Where it is the key of a
    query's last wanted row, ``last`` is that row's id: a row of the same key
    must then have a smaller id. Without that rule every copy of a vector would
    be kept until the end.
    """

    def __init__(self, wanted: np.ndarray, limit: np.ndarray):
        self.wanted = wanted
        self.deepest = int(wanted.max())
        self.limit = limit.copy()
        self.last: list = [None] * len(wanted)
        self.kept: list[tuple] = []
        self.pending = 0
        self.room = 4 * int(wanted.sum()) + 4096

    def lower(self, limit: np.ndarray) -> None:
        for q in np.flatnonzero(limit < self.limit):
            self.last[q] = None
        self.limit = np.minimum(self.limit, limit)

    def add(self, ids: pa.Array, row: np.ndarray, q: np.ndarray, distance: np.ndarray) -> None:
        key = np.round(distance, 9)
        good = key <= self.limit[q]
        tied = key == self.limit[q]
        if tied.any():
            both = pa.concat_arrays([ids, pa.array(self.last, ids.type)])
            place = pc.rank(both, null_placement="at_end", tiebreaker="dense").to_numpy()
            good &= ~tied | (place[row] < place[len(ids) + q])
        row, q = row[good], q[good]
        if not len(row):
            return
        self.kept.append((q, key[good], distance[good], ids.take(pa.array(row))))
        self.pending += len(row)
        if self.pending > self.room:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Query numbers, distances and ids of the rows still wanted.

        Rows are sorted by their numbers; ids decide only among the rows that
        share a query's last wanted key.
        """
        q, key, distance = (np.concatenate([part[i] for part in self.kept]) for i in range(3))
        ids = pa.concat_arrays([part[3] for part in self.kept])
        order = np.lexsort((key, q))
        first = np.searchsorted(q[order], np.arange(len(self.wanted) + 1), side="left")
        full = np.flatnonzero(np.diff(first) >= self.wanted)
        edge = np.full(len(self.wanted), np.inf)
        edge[full] = key[order][first[full] + self.wanted[full] - 1]

        inside = key < edge[q]
        open_places = self.wanted - np.bincount(q[inside], minlength=len(self.wanted))
        tied = np.flatnonzero(key == edge[q])
        by = [("q", "ascending"), ("id", "ascending")]
        rows = pa.table({"q": q[tied], "id": ids.take(pa.array(tied))})
        tied = tied[pc.sort_indices(rows, sort_keys=by).to_numpy()]
        place = np.arange(len(tied)) - np.searchsorted(q[tied], q[tied], side="left")
        ends = tied[place == open_places[q[tied]] - 1]
        tied = tied[place < open_places[q[tied]]]

        self.limit[full] = edge[full]
        for at, last in zip(q[ends], ids.take(pa.array(ends)), strict=True):
            self.last[at] = last.as_py()
        left = np.concatenate([np.flatnonzero(inside), tied])
        ids = ids.take(pa.array(left))
        self.kept, self.pending = [(q[left], key[left], distance[left], ids)], 0
        return q[left], distance[left], ids


def without_spare_copies(
    vectors: np.ndarray, mask: np.ndarray | None, ids: pa.Array, deepest: int
) -> np.ndarray | None:
    """Rows that may be wanted when rows are copies of each other.

    Copies that pass the same filters have the same distance to every query, so
    of each group only the ``deepest`` smallest ids can be among the best. None
    when there is nothing to leave out.
    """
    words = np.ascontiguousarray(vectors).view(np.uint32).astype(np.uint64)
    if mask is not None:
        words = np.concatenate([words, mask.astype(np.uint64)], axis=1)
    factors = np.random.default_rng(0).integers(1, 1 << 63, words.shape[1], dtype=np.uint64)
    _, first, group, size = np.unique(
        words @ factors, return_index=True, return_inverse=True, return_counts=True
    )
    crowded = np.flatnonzero(size[group] > deepest)
    if not len(crowded):
        return None
    # Equal hashes of unequal rows are no copies.
    crowded = crowded[(words[crowded] == words[first[group[crowded]]]).all(axis=1)]
    rows = pa.table({"g": group[crowded], "id": ids.take(pa.array(crowded))})
    by = [("g", "ascending"), ("id", "ascending")]
    crowded = crowded[pc.sort_indices(rows, sort_keys=by).to_numpy()]
    place = np.arange(len(crowded)) - np.searchsorted(group[crowded], group[crowded], side="left")
    keep = np.ones(len(vectors), dtype=bool)
    keep[crowded[place >= deepest]] = False
    return np.flatnonzero(keep)


class BlockSearch:
    """Best rows of what one task reads for every query of a block.

    ``block`` holds ``ids`` (an Arrow array), ``matrix`` (one row per query), ``k`` (rows wanted
    per query), ``filters`` (how many there are; 0 when no query has one), ``filter_of``
    (per query: which one is its own) and ``limit`` (no row farther than this can be
    among the k; infinite where nothing is known). Columns of a batch: id, one flag per
    filter that tells whether the row passes, vector; with a ``screen``, which says which
    rows are to be measured for which query (see ``screening``), also band and code.
    Hits: query_id, wanted, id, distance; at most ``k`` rows per query, ranked
    by (distance rounded to 9 decimals, id). Filters are applied before ranking,
    so the k rows come from the filtered corpus.
    """

    def __init__(self, block: dict, width: int):
        self.wanted = np.asarray(block["k"], dtype=np.int64)
        self.ids, self.width, self.filters = block["ids"], width, block["filters"]
        self.filter_of = np.asarray(block["filter_of"], dtype=np.int64)
        self.slack, self.score = cosine_scorer(np.asarray(block["matrix"]))
        self.screen = block.get("screen")
        self.measured = screening(self.screen) if self.screen else None
        self.best = Best(self.wanted, np.asarray(block["limit"], dtype=np.float64))
        self.step = max(1, CELLS // max(len(self.wanted), width))
        # A row of a batch is held some ten times over: as it is, hashed, in double precision.
        self.rows = max(1, CELLS // (4 * width))

    def add(self, batch: pa.RecordBatch) -> None:
        for at in range(0, len(batch), self.rows):
            self._add(batch.slice(at, self.rows))

    def _add(self, record_batch: pa.RecordBatch) -> None:
        best, measured = self.best, self.measured
        batch = pa.Table.from_batches([record_batch])
        vectors, at = as_matrix(batch.column(2), self.width, None)
        mask = masks(batch.column(1), at, self.filters)
        ids = batch.column(0).combine_chunks().take(pa.array(at))
        if measured:
            bands = batch.column(3).to_numpy()[at]
            codes = as_matrix(batch.column(4), self.screen["codes"].shape[1], None)[0][at]
        kept = without_spare_copies(vectors, mask, ids, best.deepest)
        if kept is not None:
            vectors, ids = vectors[kept], ids.take(pa.array(kept))
            mask = None if mask is None else mask[kept]
            if measured:
                bands, codes = bands[kept], codes[kept]
        for start in range(0, len(vectors), self.step):
            own = np.arange(start, min(start + self.step, len(vectors)))
            if measured:
                wanted_for = measured(bands[own], codes[own])
                some = wanted_for.any(axis=1)
                own, wanted_for = own[some], wanted_for[some]
            if not len(own):
                continue
            rough, exact = self.score(vectors[own])
            passing = rough <= best.limit + self.slack
            if measured:
                passing &= wanted_for
            if mask is not None:
                passing &= mask[own][:, self.filter_of]
            if len(rough) > best.deepest and np.count_nonzero(passing) > best.room:
                # The k-th best of any part bounds the k-th best of the whole.
                inside = np.where(passing, rough, np.inf)
                kth = np.partition(inside, best.deepest - 1, axis=0)[best.deepest - 1]
                best.lower(kth + self.slack)
                passing &= rough <= best.limit + self.slack
            row, q = np.divmod(np.flatnonzero(passing), len(self.wanted))
            if len(row):
                best.add(ids.take(pa.array(own)), row, q, exact(row, q))

    def hits(self) -> Iterator[pa.RecordBatch]:
        if self.best.kept:
            q, distance, ids = self.best.shrink()
            columns = [self.ids.take(pa.array(q)), pa.array(self.wanted[q]), ids, pa.array(distance)]
            names = ["query_id", "wanted", "paper_id", "distance"]
            yield pa.RecordBatch.from_arrays(columns, names)


def nearest_rows(block: dict, width: int) -> Callable[[Iterator], Iterator]:
    """A ``BlockSearch`` over one task's input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = BlockSearch(block, width)
        for batch in batches:
            search.add(batch)
        yield from search.hits()

    return run


# --- many blocks in one scan ---------------------------------------------------------


def packed_block(table: pa.Table) -> pa.Table:
    """One row with all queries of a block: their columns as an Arrow stream."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return pa.table({"block": table["block"][:1], "payload": pa.array([out.getvalue()], pa.binary())})


def unpacked_block(payload: bytes, width: int) -> dict | None:
    """What ``packed_block`` packed, as a ``BlockSearch`` wants it; None when no query of it has a direction."""
    table = pa.ipc.open_stream(payload).read_all()
    matrix, _ = as_matrix(table["embedding"], width, np.float64)
    usable = np.flatnonzero(matrix.any(axis=1) & ~np.isnan(matrix).any(axis=1))
    if not len(usable):
        return None
    column = {n: table[n].to_numpy()[usable] for n in ("k", "filter_of", "limit")}
    return {"ids": table["query_id"].combine_chunks().take(pa.array(usable)), "matrix": matrix[usable], **column}


def grid_rows(filters: int, width: int) -> Callable[[Iterator], Iterator]:
    """A ``BlockSearch`` for every block that the first row of a task's input carries.

    The fourth column holds a block or nothing; a row that was joined to several blocks
    comes once for each, and counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, begun = [], False
        for batch in batches:
            carries = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            if carries.any():
                for payload in batch.column(3).filter(pa.array(carries)).to_pylist():
                    block = unpacked_block(payload, width)
                    if block:
                        searches.append(BlockSearch({**block, "filters": filters}, width))
                once = np.zeros(len(carries), dtype=bool)
                once[np.flatnonzero(carries)[:1]] = not begun
                batch, begun = batch.filter(pa.array(~carries | once)), True
            for search in searches:
                search.add(batch)
        for search in searches:
            yield from search.hits()

    return run


# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
