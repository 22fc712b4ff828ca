"""Bottom-k sketches of shingle hashes, as column expressions.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's
shingles. The sketch of a union is the bottom k of the sketches' union, so parts can
be sketched apart and merged, in a row (``merged``) or over groups of rows
(``merge_groups``). Two sketches estimate resemblance, containment and, each alone,
the number of distinct shingles. Everything is a DataFrame expression.

Words are what lies between ASCII white space after lower-casing A-Z; a shingle is
five words in a row; a text of one to four words is one shingle; a text without words
has an empty sketch.

Defined results: a null text counts as empty; two empty sketches resemble each other
fully, an empty and a filled one not at all; repeated rows give repeated results; an
empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import ascii_lower

WORDS = 5
K = 128
# Rows of one range of ids in ``successors``, and the most ranges; beyond that ranges
# grow and their windows spill.
RANGE_ROWS = 512
MOST_RANGES = 1 << 14


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), "")


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """Hashes of all shingles, repeated ones too."""

    def hashed(found: Column) -> Column:
        number = F.size(found)
        many = F.transform(F.sequence(F.lit(1), number - (width - 1)), lambda i: F.xxhash64(F.slice(found, i, width)))
        one = F.array(F.xxhash64(found))
        none = F.array().cast("array<bigint>")
        return F.when(number >= width, many).when(number > 0, one).otherwise(none)

    # The words are bound once, as an element of a one-element array.
    return F.get(F.transform(F.array(words(text)), hashed), 0)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WORDS) -> Column:
    return bottom(shingle_hashes(text, width), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """``key, sketch`` of each group of parts.

    The hashes of a group are counted apart, so that no task holds more than the
    distinct hashes of its parts, and each task keeps k of a key before the shuffle.
    """
    hashes = parts.select(key, F.explode(column).alias("hash")).distinct()
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(32)))
    first = Window.partitionBy(key, "salt").orderBy("hash")
    least = salted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    return least.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("hash")), 1, k).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _range_of(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are not above ``value``, by bisection."""
    number = len(bounds)
    if not number:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << p for p in range(number.bit_length() - 1, -1, -1)]

    def step(low: Column, width: Column) -> Column:
        reached = low + width
        return F.when((reached <= number) & (F.get(listed, reached - 1) <= value), reached).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def successors(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows ``doc_id, text, next_text, extra`` and the window they stand in.

    The next document is the one with the next smaller id; after the smallest comes
    the largest. Ids are cut into ranges of about equal row counts, so that texts are
    shuffled once and each window stays small; the first row of each range is added
    to the range before it as an ``extra`` row. Null ids come last, equal ids are
    ordered by a hash of the text.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    total = rows.count()
    number = max(1, min(MOST_RANGES, -(-total // RANGE_ROWS)))
    shares = [i / number for i in range(1, number)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * number).alias("b")).first().b if shares else []
    bounds = sorted(set(found or []))
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(bounds, F.col("doc_id")))
    ranged = rows.withColumn("at", at)

    # At most MOST_RANGES + 1 rows: the largest id of each range.
    tops = sorted(ranged.groupBy("at").agg(F.max("doc_id").alias("top")).collect(), reverse=True)
    before = [tops[i - 1].at for i in range(len(tops))]
    listed = [(t.top, target) for t, target in zip(tops, before, strict=True)]
    heads = docs.sparkSession.createDataFrame(listed, "top long, target int")
    head = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top")))
    extra = head.groupBy("target").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    all_rows = ranged.select("doc_id", "text", "at", F.lit(False).alias("extra")).unionByName(
        extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("target").alias("at"), F.lit(True).alias("extra"))
    )
    window = Window.partitionBy("at").orderBy("extra", F.col("doc_id").desc_nulls_last(), "order")
    ordered = all_rows.withColumn("order", F.xxhash64("text"))
    return ordered.withColumn("next_text", F.lead("text").over(window)), window


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half (rounded down) replaced by as many first
    characters of the next document, see ``successors``.
    """
    rows, window = successors(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    made = (
        rows.withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("own", sketch(F.col("text"), k))
        .withColumn("other", sketch(F.col("edited"), k))
        .withColumn("following", F.lead("own").over(window))
        .filter(~F.col("extra"))
    )
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("shingles_estimate"),
    )
