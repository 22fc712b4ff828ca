"""Text cleaning as column expressions.

Whitespace means the 29 code points Python treats as such. Java's ``\\s`` and
Spark's plain ``trim`` know fewer, so both forms below are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace code points, as a character class and as a set.
# Single characters are looked up faster than ranges.
WHITESPACE_RANGES = (
    r"\x{9}\x{a}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}\p{Z}"
)
WHITESPACE = f"[{WHITESPACE_RANGES}]"
WHITESPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

TITLE_CHARS, AUTHORS_CHARS, VENUE_CHARS, DOI_CHARS, CATEGORY_CHARS = 4000, 2000, 500, 256, 500


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def clean_title(title: Column) -> Column:
    return F.substring(collapse(F.coalesce(title, F.lit(""))), 1, TITLE_CHARS)


def clean_abstract(abstract: Column) -> Column:
    return collapse(F.coalesce(abstract, F.lit("")))


def combined_text(title: Column, abstract: Column) -> Column:
    """The text an embedding is made from: title, blank line, abstract."""
    return strip(F.concat(strip(title), F.lit("\n\n"), strip(abstract)))


def normalize_text(value: Column) -> Column:
    """Bytes or string to a valid string; a bad byte becomes U+FFFD, null stays null."""
    return F.make_valid_utf8(value.cast("string"))


def strip_control_chars(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\x{0}-\x{1f}\x{7f}]", " "))


def snippet(text: Column, chars: int) -> Column:
    """The first characters of a text on one line."""
    return F.translate(F.substring(F.coalesce(text, F.lit("")), 1, chars), "\n", " ")
