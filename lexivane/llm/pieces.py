"""Encoding with a local vocabulary file of the tokenizers library, piece by piece.

A byte-level tokenizer splits a text before it merges bytes, and a single space
between two visible characters is always the start of a new part. So a text can be
cut at such spaces and its segments encoded one by one: the ids are those of the
whole text. Natural text repeats its words, so each worker keeps the ids of the
segments it has met, up to a bound, and the library sees a segment once.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexivane.llm.common import give_back, hold_cache, slices

# A space is a safe cut between two of these: letters, digits, visible ASCII.
VISIBLE = r"[\w!-~]"
SAFE_SPACE = re.compile(f"(?<={VISIBLE}) (?={VISIBLE})")
WHOLE_PIECE = re.compile(f"{VISIBLE}(?:.*{VISIBLE})?", re.DOTALL)
# What one worker may keep, and what one kept piece takes besides its text and ids: two
# offsets, a count, two flags.
CACHE_BYTES = 16 << 20
ENTRY_BYTES = 22
# A word of Latin letters is one part, marks behind it others.
LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
LETTERS = re.compile(LATIN)
WORD = rf"\A(?P<word>{LATIN})(?P<marks>[!-/:-@\[-`{{-~]*)\z"
# Byte-level vocabularies spell a byte of these ranges as the character of its
# number, all others as the characters from 256 on, in order.
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHER_BYTES = sorted(set(range(256)) - set(OWN_BYTES))
SPELLED = {byte: 256 + place for place, byte in enumerate(OTHER_BYTES)}
SPACE = chr(SPELLED[32])
SPELLING = np.arange(256, dtype="<u4")
SPELLING[list(SPELLED)] = list(SPELLED.values())
# Text split at once: every different word of it is a Python string for a while.
TEXT_BYTES = 8 << 20
# Rows taken at once, for texts that are short.
ROWS_AT_ONCE = 20_000
# New pieces that are learned at once, and those that are encoded as one text.
LEARNED_AT_ONCE = 20_000
PIECES_AT_ONCE = 2000


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """For code that makes many small objects and no cycles: Python does not look for any."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class PieceEncoder:
    """Ids of texts, equal to what the library gives for each whole text.

    The strings of special tokens are ordinary text, and none are added.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        self.inner = Kept(cache_bytes, self.kind)
        self.first = Kept(cache_bytes // 8, self.kind)
        give_back()  # reading a vocabulary takes as much again as the vocabulary

    def _pieces(self, kept: Kept, pieces: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and ids of the pieces, and which are no safe segment (no ids)."""
        # A word comes alone and with several marks; its ids are made once.
        parts = pc.extract_regex(pieces, WORD)
        words = pc.coalesce(pc.struct_field(parts, 0), pieces)
        marks = pc.fill_null(pc.struct_field(parts, 1), "").dictionary_encode()
        place, new = kept.places(words)
        few = (new[at : at + LEARNED_AT_ONCE].to_pylist() for at in range(0, len(new), LEARNED_AT_ONCE))
        kept.add(new, [self._learn(kept, some, before) for some in few], place)
        both = pa.concat_arrays([kept.ids, raw_lists(self._each(marks.dictionary.to_pylist()), self.kind)])
        turns = np.stack([place, marks.indices.to_numpy() + len(kept.ids)], axis=1)
        taken = both.take(pa.array(turns.reshape(-1)))
        sizes = np.diff(taken.offsets.to_numpy()).reshape(-1, 2).sum(axis=1)
        return sizes, taken.values.to_numpy(), kept.unsafe[place]

    def _learn(self, kept: Kept, new: list[str], before: str) -> pa.Array:
        """The ids of pieces not met yet; those that are no safe segment get null."""
        words, whole, odd = [], [], []
        for place, piece in enumerate(new):
            (words if LETTERS.fullmatch(piece) else whole if WHOLE_PIECE.fullmatch(piece) else odd).append(place)
        sizes, ids = self._merged([new[place] for place in words], SPACE if before else "")
        others = [new[place] for place in whole]
        others = self._joined(others) if before else self._each(others)
        found = pa.concat_arrays([id_lists(sizes, ids), raw_lists(others, self.kind), pa.nulls(len(odd), kept.ids.type)])
        return found.take(pa.array(np.argsort(np.array(words + whole + odd, np.int64))))

    def _merged(self, words: list[str], first: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of Latin letters, which need no splitting rules."""
        sizes, ids, merge = [], array(self.code), self.tokenizer.model.tokenize
        # No byte of a letter is spelled as a comma.
        spelled = SPELLING[np.frombuffer(",".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        for word in spelled.split(",") if words else ():
            tokens = merge(first + word)
            sizes.append(len(tokens))
            ids.extend([t.id for t in tokens])
        return np.array(sizes, np.int64), np.array(ids, self.kind)

    def _each(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces with a space before each, many pieces encoded as one text.

        A piece holds no space itself, so its ids run from one that begins with a space to
        the next.
        """
        found: list[bytes] = []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            part = pieces[at : at + PIECES_AT_ONCE]
            (whole,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(whole.ids, self.kind)
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(part) and cuts[0] == 0:
                raw, width = ids.tobytes(), self.kind.itemsize
                ends = [*(cuts[1:] * width).tolist(), len(raw)]
                found += [raw[a:b] for a, b in zip((cuts * width).tolist(), ends, strict=True)]
            else:
                found += self._each([" " + p for p in part])
        return found

    @without_cycle_search()
    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, as arrays of ``kind``; a null text has none."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        texts = texts.fill_null("")
        return [ids for few in slices(texts, TEXT_BYTES) for ids in self._encode(few)]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        self.inner.make_room()
        self.first.make_room()
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        begins, ends = edges[:-1], edges[1:]
        coded = split.values.dictionary_encode()
        slot, spelled = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())
        del split, coded

        # Pieces after a space, each different one once; then those a text starts with.
        after = np.ones(len(slot), bool)
        after[begins] = False
        used = np.zeros(len(spelled), bool)
        used[slot[after]] = True
        starting, slot[begins] = np.unique(slot[begins], return_inverse=True)
        slot[begins] += len(spelled)
        inner, first = spelled.filter(pa.array(used)), spelled.take(pa.array(starting))
        found = self._pieces(self.inner, inner, " "), self._pieces(self.first, first, "")

        sizes, ids, unsafe = (np.concatenate(both) for both in zip(*found, strict=True))
        kept = id_lists(sizes, ids)
        place = np.zeros(len(spelled) + len(first), np.int64)
        place[np.flatnonzero(used)] = np.arange(len(inner))
        place[len(spelled) :] = np.arange(len(inner), len(sizes))
        slot = place[slot]
        # A text with a piece that starts or ends with something else than a visible character.
        odd = np.logical_or.reduceat(unsafe[slot], begins)
        taken = kept.take(pa.array(slot))
        ids, upto = taken.values.to_numpy(), taken.offsets.to_numpy()
        last = upto[ends].tolist()
        return [
            np.frombuffer(self._encode_segments(texts[place].as_py()), self.kind) if is_odd else ids[a:b]
            for place, (is_odd, a, b) in enumerate(zip(odd.tolist(), [0, *last[:-1]], last, strict=True))
        ]

    def _encode_segments(self, text: str) -> bytes:
        segments = SAFE_SPACE.split(text)
        spaced = segments[:1] + [" " + s for s in segments[1:]]
        encoded = self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)
        return b"".join(array(self.code, e.ids).tobytes() for e in encoded)


def joined_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Small batches of texts joined: each call to ``encode`` looks through all that is kept."""
    held, size, rows = [], 0, 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and (size + more > TEXT_BYTES or rows + len(batch) > ROWS_AT_ONCE):
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + more, rows + len(batch)
    if held:
        yield pa.concat_batches(held)


def id_lists(sizes: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of these sizes, one after another in ``ids``."""
    edges = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=edges[1:])
    return pa.LargeListArray.from_arrays(pa.array(edges), pa.array(ids))


def raw_lists(found: list[bytes], kind: np.dtype) -> pa.Array:
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
    return id_lists(sizes, np.frombuffer(b"".join(found), kind))


class Kept:
    """Ids by piece, in Arrow arrays; the pieces met least make room."""

    def __init__(self, most_bytes: int, kind: np.dtype) -> None:
        self.most = most_bytes
        self.pieces = pa.array([], pa.large_string())
        self.ids = raw_lists([], kind)
        self.unsafe = np.zeros(0, bool)
        self.met = np.zeros(0, np.int32)

    def make_room(self) -> None:
        """Beyond the bound half of it stays; what was met long ago counts less."""
        width = ENTRY_BYTES + self.ids.type.value_type.bit_width // 8 * np.diff(self.ids.offsets.to_numpy())
        size = width + pc.binary_length(self.pieces).to_numpy()
        if size.sum() > self.most:
            order = np.lexsort((-np.arange(len(size)), -self.met))
            stay = np.sort(order[np.cumsum(size[order]) <= self.most // 2])
            self.pieces, self.ids = self.pieces.take(pa.array(stay)), self.ids.take(pa.array(stay))
            self.unsafe, self.met = self.unsafe[stay], self.met[stay] // 2

    def places(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each piece is or will be, and the different ones that are not kept, in that order."""
        coded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        return coded.indices[len(self.pieces) :].to_numpy(), coded.dictionary[len(self.pieces) :]

    def add(self, new: pa.Array, ids: list[pa.Array], place: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.ids = pa.concat_arrays([self.ids, *ids])
        self.unsafe = self.ids.is_null().to_numpy(zero_copy_only=False)
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[place] += 1


_loaded = lru_cache(maxsize=4)(PieceEncoder)


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a process."""
    hold_cache("pieces", _loaded.cache_clear)
    return _loaded(path)
