"""Exact duplicates: hash groups, verified byte by byte.

Rows are grouped by a 128-bit content hash of the normalised text. One row of a
group stays: the one with the largest id. Before groups are trusted, the texts
inside each are compared; a hash that stands for several texts is replaced by
hash and text together, so a collision never joins two texts.

Defined results: a null text counts as empty; texts are equal when they are
identical after lower-casing A-Z; rows with a null id are smaller than any id and
stay only where no row of the group has one; of rows that repeat both id and text
exactly one stays; an empty table gives an empty result. Only the id and the text
column are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import ascii_lower, free_name, maybe_broadcast, staged

# Groups larger than this share of all rows are joined by broadcast: there are at
# most as many of them as the share says, whatever the data.
HOT_SHARE = 4096
HOT_LEAST = 1000
# What a broadcast hash key and its counters take.
GROUP_BYTES = 160


def _keyed(docs: DataFrame, id_column: str, text_column: str, key_bits: int) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    if key_bits % 8 or not 8 <= key_bits <= 128:
        raise ValueError("key_bits must be a multiple of 8 up to 128")
    return rows.withColumn("key", F.substring("sha", 1, key_bits // 8))


def _shared_keys(slim: DataFrame) -> DataFrame:
    return slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _collided(keyed: DataFrame, slim: DataFrame) -> DataFrame:
    """Keys that stand for more than one text: the texts themselves are compared.

    Only rows whose key occurs more than once take part. Equal texts collapse in
    each task before the shuffle, so a large group of copies sends one row a task.
    """
    shared = staged(_shared_keys(slim).select("key"), "exact-shared")
    wanted = maybe_broadcast(shared, shared.count(), GROUP_BYTES)
    texts = keyed.select("key", "text").join(wanted, "key", "left_semi").groupBy("key", "text").agg(F.count(F.lit(1)))
    return texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row a key, member count ``n``).

    A key with a great share of all rows would land in one task. Such groups are
    broadcast; their number is bounded by ``HOT_SHARE`` because their rows add up
    to ``total`` at most. All others are joined by the key.
    """
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot, cold = groups.filter(F.col("n") > limit), groups.filter(F.col("n") <= limit)
    of_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return of_hot.unionByName(others)


def hashed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key_bits: int = 128) -> DataFrame:
    """Written rows ``doc_id, uid, key, sha``; equal keys mean equal texts.

    ``key_bits`` is the width of the grouping hash; tests narrow it to meet
    collisions.
    """
    keyed = _keyed(docs, id_column, text_column, key_bits)
    uid = F.monotonically_increasing_id().alias("uid")
    slim = staged(keyed.select("doc_id", uid, "key", "sha"), "exact-slim")
    collided = staged(_collided(keyed, slim), "exact-collided")
    number = collided.count()
    if number == 0:
        return slim
    flagged = maybe_broadcast(collided.withColumn("several", F.lit(True)), number, GROUP_BYTES)
    own = F.when(F.col("several"), F.concat("key", F.encode("text", "utf-8"))).otherwise(F.col("key"))
    widened = keyed.join(flagged, "key", "left").select("doc_id", uid, own.alias("key"), "sha")
    return staged(widened, "exact-slim")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """``key, n, keep_id, keep_uid`` of every group of two or more rows."""
    return (
        rows.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("uid", "doc_id"), F.max("uid")).alias("keep_uid"),
        )
        .filter("n > 1")
    )


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key_bits: int = 128
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``."""
    rows = hashed_rows(docs, id_column, text_column, key_bits)
    marked = attach_groups(rows, duplicate_groups(rows), "key", rows.count())
    grouped = F.col("n").isNotNull()
    return marked.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows to drop are named by id and hash. Rows that repeat both cannot be told
    apart that way; where there are any, one of each is taken.
    """
    rows = hashed_rows(docs, id_column, text_column)
    marked = staged(
        attach_groups(rows, duplicate_groups(rows), "key", rows.count())
        .filter(F.col("n").isNotNull())
        .select("doc_id", "sha", F.expr("uid = keep_uid").alias("kept")),
        "exact-marked",
    )
    per_row = marked.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies"), F.max("kept").alias("kept"))
    losers = staged(per_row.filter("not kept").select("doc_id", "sha"), "exact-losers")
    repeats = staged(per_row.filter("kept and copies > 1").select("doc_id", "sha"), "exact-repeats")

    sha, lost_id, lost_sha = (free_name(docs.columns, n) for n in ("sha", "lost_id", "lost_sha"))
    text = ascii_lower(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    hashed = docs.withColumn(sha, F.unhex(F.sha2(text, 256)))

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.col("doc_id").alias(lost_id), F.col("sha").alias(lost_sha))

    same = F.col(id_column).eqNullSafe(F.col(lost_id)) & (F.col(sha) == F.col(lost_sha))
    left = hashed.join(maybe_broadcast(named(losers), losers.count(), GROUP_BYTES), same, "left_anti")
    repeated = repeats.count()
    if repeated == 0:
        return left.drop(sha)
    again = maybe_broadcast(named(repeats), repeated, GROUP_BYTES)
    once = left.join(again, same, "left_semi").dropDuplicates([id_column, sha])
    return left.join(again, same, "left_anti").unionByName(once).drop(sha)

