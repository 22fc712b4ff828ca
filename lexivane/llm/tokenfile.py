"""Token ids in files of fixed-width packed bits.

A file holds blocks, then a footer, then a trailer of 48 bytes::

    block 0 | block 1 | ... | doc ids | id is null | id offsets | block offsets | trailer

Each id takes the fewest bits that hold the largest id of the vocabulary. A block has
``BLOCK`` ids (the last may have fewer, filled up to a multiple of 64) as 64-bit
little-endian words: 64 ids make ``bits`` words, so whole columns are packed and
unpacked at once. Offsets of documents (in ids) and of blocks (in bytes) allow any
range of ids to be read without what lies before it.

Files are written by the tasks that encoded them, under a name of the attempt, and
moved into place when complete; only files whose tasks were committed appear in the
manifest, so a lost executor or a second attempt leaves no trace in the result.
The folder may be on any store that pyarrow opens (file, hdfs, s3, gs).

Defined results: documents are in ascending id order, null ids first, equal ids by a
hash of the text; a null text counts as empty and has the end id alone; repeated rows
are written as often as they occur; an empty table gives no documents. Only the id
and the text column are read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm.common import staged
from lexivane.llm.pieces import joined_batches, piece_encoder

BLOCK = 1 << 14
LANES = 64
MAGIC = b"LXVTOK01"
TRAILER = struct.Struct("<8sIIQQQQ")
MANIFEST = "part int, path string, docs long, tokens long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
# Ids decoded at once when a file is read through.
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, filled up with zeros to a multiple of 64 ids."""
    rows = -(-len(ids) // LANES)
    lanes = np.zeros((rows, LANES), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, bits), "<u8")
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack_bits(raw: bytes, bits: int, number: int) -> np.ndarray:
    """The first ``number`` ids of ``raw``."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), LANES), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[:number]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class TokenWriter:
    """One file, written block by block."""

    def __init__(self, sink, bits: int) -> None:
        self.sink, self.bits = sink, bits
        self.waiting: list[np.ndarray] = []
        self.held = self.written = self.tokens = 0
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.offsets, self.blocks = [0], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.tokens += len(ids)
        self.offsets.append(self.tokens)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, end, BLOCK):
            raw = pack_bits(ids[at : min(at + BLOCK, end)], self.bits)
            self.sink.write(raw)
            self.written += len(raw)
            self.blocks.append(self.written)
        self.waiting, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.offsets, "<i8"), (self.blocks, "<i8")):
            self.sink.write(np.array(values, kind).tobytes())
        docs, blocks = len(self.doc_ids), len(self.blocks) - 1
        self.sink.write(TRAILER.pack(MAGIC, self.bits, BLOCK, docs, blocks, self.tokens, self.written))
        self.sink.close()


class TokenReader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        system, path = file_system(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        fields = TRAILER.unpack(self.source.read_at(TRAILER.size, size - TRAILER.size))
        magic, self.bits, self.block, docs, blocks, self.tokens, at = fields
        if magic != MAGIC:
            raise ValueError(f"no token file: {uri}")

        def read(kind: str, number: int) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize * number
            values = np.frombuffer(self.source.read_at(width, at), kind)
            at += width
            return values

        self.doc_ids, self.nulls = read("<i8", docs), read("u1", docs).astype(bool)
        self.offsets, self.blocks = read("<i8", docs + 1), read("<i8", blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from the blocks that hold them."""
        if start >= end:
            return np.empty(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        at = int(self.blocks[first])
        raw = self.source.read_at(int(self.blocks[last + 1]) - at, at)
        found = unpack_bits(raw, self.bits, (last - first + 1) * self.block)
        return found[start - first * self.block : end - first * self.block]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.offsets[number]), int(self.offsets[number + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``doc id, start, ids`` of each document, reading ahead in bounded steps."""
        at, held = 0, np.empty(0, "<u4")
        for number, (a, b) in enumerate(zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False)):
            if b > at + len(held):
                at, held = a, self.ids(a, max(b, min(a + READ_IDS, self.tokens)))
            doc_id = None if self.nulls[number] else int(self.doc_ids[number])
            yield doc_id, a, held[a - at : b - at]


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Encodes ``docs`` in ascending id order into files below ``folder``; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = piece_encoder(path)
        end = np.array([end_id], encoder.kind)
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.tok"
        writer = None
        for batch in joined_batches(batches, 1):
            if writer is None:
                writer = TokenWriter(system.open_output_stream(f"{base}/_{name}"), bits_for(encoder.vocabulary))
            encoded = encoder.encode(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            system.move(f"{base}/_{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([f"{folder}/{name}"]),
                    pa.array([len(writer.doc_ids)], pa.int64()),
                    pa.array([writer.tokens], pa.int64()),
                ],
                names=["part", "path", "docs", "tokens"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(run, MANIFEST), "tokens-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    The manifest has one row a file; its running sum gives each file its first start.
    """
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((row.path, start))
        start += row.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[list] = [[], [], [], []]
                for doc_id, at, ids in TokenReader(uri).documents():
                    for column, value in zip(rows, (doc_id, first + at, len(ids), zlib.crc32(ids)), strict=True):
                        column.append(value)
                    if len(rows[0]) == 10_000:
                        yield _digests(rows)
                        rows = [[], [], [], []]
                yield _digests(rows)

    listed = spark.createDataFrame(files, "path string, first long")
    return listed.repartition(max(1, len(files))).mapInArrow(run, DIGESTS)


def _digests(rows: list[list]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=names)
