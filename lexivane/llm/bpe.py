"""Byte-level BPE with the tiktoken library and a local rank file.

Ids are those of ``encode_ordinary`` over the whole text: special tokens do not
exist here, their strings are ordinary text. Long texts are cut at boundaries that
no match of the pre-splitting pattern can cross, so that the library never holds
more than a window: first at single spaces between visible characters, and where a
window has none, at the start of a match that follows a visible character. Decoding
gives bytes, as an id may hold part of a character.

Defined results: a null text counts as empty and has no ids; repeated rows give
repeated results; an empty table gives an empty result. Only the id and the text
column are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Texts longer than this many characters are cut.
WINDOW = 1 << 16
SAFE_SPACE = regex.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
RESULT = "doc_id long, n_tokens long, ids binary, decoded binary"


def cuts(text: str, pattern: regex.Pattern, window: int = WINDOW) -> Iterator[str]:
    """Parts of ``text`` whose matches are, one after another, those of the text.

    A part ends before a space that stands between two visible characters. Where
    there is none within a window, the matches themselves are followed until one
    starts after a visible character; one long match stays whole.
    """
    start = 0
    while len(text) - start > window:
        found = SAFE_SPACE.search(text, start + window, min(len(text), start + 2 * window))
        end = found.start() if found else _match_start(text, pattern, start, start + window)
        yield text[start:end]
        start = end
    yield text[start:]


def _match_start(text: str, pattern: regex.Pattern, start: int, least: int) -> int:
    for match in pattern.finditer(text, start):
        at = match.start()
        if at >= least and at > start and not text[at - 1].isspace() and text[at - 1] > " ":
            return at
    return len(text)


class RankCodec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, window: int = WINDOW) -> np.ndarray:
        if len(text) <= window:
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        parts = [np.array(self.encoding.encode_ordinary(p), "<u4") for p in cuts(text, self.pattern, window)]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str) -> RankCodec:
    """One codec a process."""
    return RankCodec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids as little-endian unsigned 32-bit integers.

    With ``digests`` both binaries are their SHA-256 digests, so that results stay
    narrow where only a comparison is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path, pattern)
        for batch in batches:
            counts, ids_out, decoded_out = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                raw, decoded = ids.tobytes(), codec.decode(ids)
                counts.append(len(ids))
                ids_out.append(hashlib.sha256(raw).digest() if digests else raw)
                decoded_out.append(hashlib.sha256(decoded).digest() if digests else decoded)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_out, pa.binary()),
                    pa.array(decoded_out, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
