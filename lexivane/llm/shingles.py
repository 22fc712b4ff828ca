"""Word shingles of texts as sorted arrays of 64-bit hashes (numpy, inside tasks).

Words are what lies between ASCII white space after lower-casing A-Z; a shingle is
``WORDS`` words in a row; a text of fewer words is one shingle of all of them; a text
without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexivane.llm.common import hold_cache, slices
from lexivane.llm.shinglehash import shingle_spans, words_of, xxh64_spans

WORDS = 5
SEED = 5
# Text hashed at once; each of its many arrays is larger than the text.
TEXT_BYTES = 1 << 20
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hold_cache("shingles", lambda: None)
    return [hashes for few in slices(texts, TEXT_BYTES) for hashes in _shingle_sets(few)]


def _shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    words = words_of(texts)
    start, length, counts = shingle_spans(words, WORDS)
    hashes = xxh64_spans(words.buffer, start, length, SEED)
    ends = np.cumsum(counts)
    # Sorted by text, then by hash; repeats within a text are dropped.
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    upto = np.concatenate([[0], np.cumsum(new)])
    hashes, edges = hashes[new], [0, *upto[ends].tolist()]
    return [hashes[a:b] for a, b in zip(edges, edges[1:], strict=False)]
