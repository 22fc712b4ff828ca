"""Secrets in texts: keyword prefilter, anchored patterns near hits, checksums.

One Aho-Corasick automaton finds the keywords of all kinds in one pass over the
lower-cased text. Only where a keyword starts is the pattern of its kind tried,
anchored there. Kinds whose format embeds a checksum are kept only if it holds.

Base kinds have no checksum: ``assign`` (a name, a separator, a value of 6 or more
characters), ``access`` (an access key id of 20 or more characters) and ``hex`` (24
or more lower-case hexadecimal digits; its keywords are all groups of four such
digits). Kinds with a checksum: ``github`` and ``npm`` (30 characters and their
CRC-32 in base 62) and ``xprv`` (an extended private key in Base58Check).

Matches of one kind are leftmost and do not overlap; a match that fails its length
or checksum is dropped after it has used up its characters. Kinds may overlap each
other. Offsets are code points, the end is exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows give
repeated results; an empty table gives an empty result. Only the named columns are
read or, for redaction, all are kept as they are but for the text and its length.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexivane.llm.common import hold_cache

RESULT = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"
MASK = "[secret]"

# Digits of base 62 and of Base58 in their order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX = "0123456789abcdef"


def crc_in_base62(token: str) -> bool:
    """The last six characters are the CRC-32 of those after the prefix."""
    body, tail = token[token.index("_") + 1 : -6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == tail


def base58_check(token: str) -> bool:
    """Four bytes of a double SHA-256 close the value."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    accepts: Callable[[re.Match], bool]


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
# In the order in which spans of one start are listed.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: m.end(2) - m.start(2) >= 6),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    Kind("hex", tuple(map("".join, itertools.product(HEX, repeat=4))), re.compile("[0-9a-f]+"), lambda m: m.end() - m.start() >= 24),
    Kind("github", tuple(f"gh{c}_" for c in "pousr"), re.compile("gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_in_base62(m[0])),
    Kind("npm", ("npm_",), re.compile("npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_in_base62(m[0])),
    Kind("xprv", ("xprv",), re.compile("xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"), lambda m: base58_check(m[0])),
)
BASE_KINDS = 3
TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1)
def automaton():
    """The keywords of all kinds, each with its kinds and length; one a process."""
    import ahocorasick

    hold_cache("secrets", automaton.cache_clear)

    meanings: dict[str, tuple[int, list[int]]] = {}
    for number, kind in enumerate(KINDS):
        for word in kind.keywords:
            meanings.setdefault(word, (len(word) - 1, []))[1].append(number)
    built = ahocorasick.Automaton()
    for word, meaning in meanings.items():
        built.add_word(word, meaning)
    built.make_automaton()
    return built


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)``, ordered."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer would move offsets
        lowered = text.translate(TO_LOWER)
    free = [0] * len(KINDS)
    # Keywords of one kind and different lengths end in another order than they start.
    late: list[tuple[int, int]] = []
    found = []
    for end, (back, numbers) in automaton().iter(lowered):
        start = end - back
        for number in numbers:
            if number:
                if start >= free[number]:
                    _try(text, start, number, free, found)
            else:
                late.append((start, number))
    for start, number in sorted(late):
        if start >= free[number]:
            _try(text, start, number, free, found)
    return sorted(found)


def _try(text: str, start: int, number: int, free: list[int], found: list[tuple[int, int, int]]) -> None:
    match = KINDS[number].pattern.match(text, start)
    if match:
        free[number] = match.end()
        if KINDS[number].accepts(match):
            found.append((start, number, match.end()))


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, kinds, starts, ends``: the spans of every text, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_secrets(text) if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[KINDS[k].name for _, k, _ in s] for s in spans], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in s] for s in spans], pa.list_(pa.int32())),
                    pa.array([[b for _, _, b in s] for s in spans], pa.list_(pa.int32())),
                ],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def masked(text: str, mask: str = MASK) -> str:
    """The text with every secret replaced; overlapping spans become one."""
    parts, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked and the length column, if there is one, kept true."""
    names = docs.columns
    at = names.index(text_column)
    length_at = names.index(length_column) if length_column in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            after = [masked(t) if t else t for t in texts]
            columns[at] = pa.array(after, columns[at].type)
            if length_at is not None:
                kept = columns[length_at].to_pylist()
                lengths = [n if a == b else len(a) for n, a, b in zip(kept, after, texts, strict=True)]
                columns[length_at] = pa.array(lengths, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
