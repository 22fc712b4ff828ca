"""Hashes of all word shingles of a batch of texts at once (numpy, inside tasks).

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A shingle is
``words`` words in a row joined by single spaces, repeats included; a text of fewer words
is one shingle of all of them, a text without words has none. Hashes are XXH64 of the
shingle's bytes. Everything is done on the one buffer that holds the texts of a batch; no
Python object is made per word or shingle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

# The primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Shingles hashed at a time, so that what is held per shingle fits the processor's cache.
AT_ONCE = 1 << 15
TAIL = 8  # bytes behind the last word, so that eight may be read anywhere


class Words(NamedTuple):
    """The words of all texts in one buffer, one byte between two; words of each text."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """``texts`` are strings or bytes; null is a text without words."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    edges = offsets - offsets[0]
    inner = edges[(edges > 0) & (edges < len(data))]

    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin

    end = np.cumsum(length + 1) - 1
    total = int(end[-1]) + 1 if len(end) else 0
    buffer = np.full(total + TAIL, 32, np.uint8)
    place = np.ones(total, bool)
    place[end] = False
    buffer[:total][place] = LOWER[data[word]]
    return Words(buffer, end - length, end, np.diff(np.searchsorted(begin, edges)))


def shingle_spans(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every shingle in the buffer, and how many each text has."""
    counts = words.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    before = np.repeat(ends - counts - (np.cumsum(shingles) - shingles), shingles)
    first = np.arange(int(shingles.sum())) + before
    last = np.minimum(first + width, np.repeat(ends, shingles)) - 1
    start = words.start[first]
    return start, words.end[last] - start, shingles


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(state + lane * P2, 31) * P1


def _hash_sorted(eights: np.ndarray, at: np.ndarray, length: np.ndarray, seed: np.uint64) -> np.ndarray:
    """``at`` and ``length`` by falling length, so each step works on a leading part."""
    zero = np.uint64(0)
    value = np.full(len(at), seed + P5, np.uint64)
    long = int((length >= 32).sum())
    if long:
        state = [np.full(long, s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        stripes = length[:long] >> 5
        for stripe in range(int(stripes[0])):
            held = int((stripes > stripe).sum())
            for i in range(4):
                state[i][:held] = _round(state[i][:held], eights[at[:held] + 32 * stripe + 8 * i])
        joined = _turned(state[0], 1) + _turned(state[1], 7) + _turned(state[2], 12) + _turned(state[3], 18)
        for part in state:
            joined = (joined ^ _round(zero, part)) * P1 + P4
        value[:long] = joined
    value += length.astype(np.uint64)
    rest, at = length & 31, at + (length & ~31)
    # What is left after whole stripes is not sorted by size any more.
    for _ in range(3):
        own = np.flatnonzero(rest >= 8)
        value[own] = _turned(value[own] ^ _round(zero, eights[at[own]]), 27) * P1 + P4
        at[own] += 8
        rest[own] -= 8
    own = np.flatnonzero(rest >= 4)
    value[own] = _turned(value[own] ^ ((eights[at[own]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[own] += 4
    rest[own] -= 4
    for _ in range(3):
        own = np.flatnonzero(rest > 0)
        value[own] = _turned(value[own] ^ ((eights[at[own]] & np.uint64(0xFF)) * P5), 11) * P1
        at[own] += 1
        rest[own] -= 1
    value = (value ^ (value >> np.uint64(33))) * P2
    value = (value ^ (value >> np.uint64(29))) * P3
    return value ^ (value >> np.uint64(32))


def xxh64_spans(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of ``buffer``, behind which ``TAIL`` more bytes must lie."""
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(start), AT_ONCE):
            part = length[begin : begin + AT_ONCE]
            order = np.argsort(-part, kind="stable")
            out[begin + order] = _hash_sorted(eights, start[begin + order], part[order], np.uint64(seed))
    return out
