"""Approximate search: banded sign codes, near bands first, until a bound says enough.

A code is the side of each of ``bits`` fixed random planes a vector lies on. The
planes do not depend on the data, so codes never need retraining. The sides of the
first ``bands`` planes are a row's band, by which the index is partitioned.

A search opens the few bands nearest to a query, and as many more as it takes to
have its k rows under its own filters. The k-th exact distance then bounds what is
left: a nearer row lies in one of the bands that hold its probability, and its code
differs in no more bits than such a row's code does, each but for a known chance.
These bands are opened, rows with codes beyond that bound are not measured, and
nothing else is read. There is no fixed number of candidates: a query whose
neighbours are far, or whose filters leave few rows, opens more bands, in the end all
of them, which is an exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.operators import kernels
from lexivane.operators.embed import once
from lexivane.operators.planning import broadcast_keys
from lexivane.operators.search import (
    Hits,
    batch_nearest,
    best_rows,
    by_block,
    no_hits,
    query_type,
)
from lexivane.options import Options

SAMPLE_QUERIES = 64  # for calibration
DEFAULT_TARGET = 0.9
# Bands opened first, and what a calibration tries beyond the target itself.
FIRST_BANDS = 4
STRICTER = (0.98, 0.99, 0.999)
# The index has a band for this many rows, within bounds.
BAND_ROWS = 1 << 16
FEWEST_BANDS, MOST_BANDS = 6, 12
# The normal distribution by a logistic one, and where its argument is cut.
LOGISTIC, STEEPEST = 1.702, 50.0


@dataclass(frozen=True)
class Tier:
    """Code size and the share of true neighbours to be found, if there is a target.

    ``expected`` is the share a search aims at by its bounds; calibration raises it
    where the share that is found falls short.
    """

    name: str
    bits: int
    target: float | None
    expected: float | None = None
    bands: int = FEWEST_BANDS

    def bytes_for(self, rows: int) -> int:
        return rows * self.bits // 8

    @property
    def share(self) -> float:
        return self.expected or self.target or DEFAULT_TARGET

    def for_rows(self, rows: int) -> Tier:
        """More bands for a larger corpus."""
        bands = (max(1, rows // BAND_ROWS) - 1).bit_length()
        return replace(self, bands=min(MOST_BANDS, max(FEWEST_BANDS, bands)))


# Best first. Targets are fixed values; lighter tiers serve smaller budgets.
TIERS = (
    Tier("256 planes", 256, 0.95),
    Tier("128 planes", 128, 0.90),
    Tier("64 planes", 64, None),
    Tier("32 planes", 32, None),
)


def tier_bits(rows: Column, budget_bytes: Column) -> Column:
    """The code bits of the best tier whose codes fit the budget; null means exact search."""
    fits = [F.when(rows * (tier.bits // 8) <= budget_bytes, tier.bits) for tier in TIERS]
    return F.coalesce(*fits)


def choose_tier(rows: int, budget_bytes: int) -> Tier | None:
    """``tier_bits`` for one corpus."""
    return next((tier for tier in TIERS if tier.bytes_for(rows) <= budget_bytes), None)


# --- the index -------------------------------------------------------------------


def sign_code(vector: Column, bits: int, dim: int) -> Column:
    return once(kernels.sign_coder(bits, dim), "array<bigint>")(vector)


def band_of(code: Column, bands: int) -> Column:
    return F.get(code, F.lit(0)).bitwiseAND(F.lit((1 << bands) - 1)).cast("int")


def code_table(corpus: DataFrame, bits: int, dim: int, bands: int = FEWEST_BANDS) -> DataFrame:
    """One row per searchable paper: the columns filters need, vector, code and band."""
    keep = [c for c in ("paper_id", "year", "category", "embedding") if c in corpus.columns]
    codes = corpus.select(*keep, sign_code(F.col("embedding"), bits, dim).alias("code"))
    return codes.filter(F.col("code").isNotNull()).withColumn("band", band_of(F.col("code"), bands))


def write_index(codes: DataFrame, path: str) -> None:
    """The code table, a folder per band, so that a search reads the bands it opens."""
    codes.hint("rebalance", "band").write.partitionBy("band").parquet(path)


# --- bounds ------------------------------------------------------------------------


@lru_cache(maxsize=32)
def reaches(bits: int, share: float) -> tuple[float, ...]:
    """For t = 0, 1, ...: the distance up to which ``share`` of all rows have a code that
    differs in t bits at most.

    A plane divides two vectors with a chance of their angle over pi.
    """
    ways = [math.lgamma(bits + 1) - math.lgamma(n + 1) - math.lgamma(bits - n + 1) for n in range(bits + 1)]
    number, ways = np.arange(bits + 1), np.array(ways)
    low, high = np.zeros(bits), np.ones(bits)
    for _ in range(60):
        chance = (low + high) / 2
        with np.errstate(divide="ignore"):
            each = ways + number * np.log(chance)[:, None] + (bits - number) * np.log1p(-chance)[:, None]
        within = np.cumsum(np.exp(each), axis=1)[np.arange(bits), np.arange(bits)] >= share
        low, high = np.where(within, chance, low), np.where(within, high, chance)
    return tuple(np.round(1 - np.cos(np.pi * low), 9).tolist())


def bits_within(distance: np.ndarray, bits: int, share: float) -> np.ndarray:
    """Bits in which the code of a row no farther than ``distance`` differs at most."""
    return np.searchsorted(np.array(reaches(bits, share)), np.round(distance, 9), side="left")


def margins(matrix: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each query lies from each of the first planes, in units of what a random
    direction adds, and on which side.
    """
    dim = matrix.shape[1]
    unit = kernels.unit_vectors(matrix)
    along = unit @ kernels.planes(max(bands, kernels.WORD_BITS), dim)[:bands].T.astype(np.float64)
    left = np.maximum(dim - along * along, 1e-12) / max(dim - 1, 1)
    return np.abs(along) / np.sqrt(left), along > 0


def _turned(above: np.ndarray, bands: int) -> np.ndarray:
    """query x band x plane: whether the band is on the other side than the query."""
    sides = np.arange(1 << bands)[:, None] >> np.arange(bands) & 1
    return sides[None] != above[:, None, :]


def band_places(matrix: np.ndarray, bands: int) -> np.ndarray:
    """query x band: place of a band in the order a query opens them first."""
    far, above = margins(matrix, bands)
    score = np.round((_turned(above, bands) * (far * far)[:, None, :]).sum(axis=2), 9)
    return np.argsort(np.argsort(score, axis=1, kind="stable"), axis=1, kind="stable")


def near_bands(matrix: np.ndarray, distance: np.ndarray, bands: int, share: float) -> np.ndarray:
    """query x band: the fewest bands that hold a row no farther than ``distance`` with
    probability ``share``.
    """
    far, above = margins(matrix, bands)
    cosine = np.clip(1 - distance, -1, 1)
    slope = cosine / np.maximum(np.sqrt(1 - cosine * cosine), 1e-9)
    crossed = 1 / (1 + np.exp(np.clip(LOGISTIC * far * slope[:, None], -STEEPEST, STEEPEST)))
    turned = _turned(above, bands)
    chance = np.where(turned, np.log(crossed)[:, None, :], np.log(1 - crossed)[:, None, :]).sum(axis=2)
    chance = np.round(np.exp(chance), 12)
    order = np.argsort(-chance, axis=1, kind="stable")
    sorted_chance = np.take_along_axis(chance, order, axis=1)
    wanted = np.cumsum(sorted_chance, axis=1) - sorted_chance < share
    out = np.zeros_like(wanted)
    np.put_along_axis(out, order, wanted, axis=1)
    return out


# --- search ------------------------------------------------------------------------


def part_of(block: dict, rows: np.ndarray) -> dict:
    """Some queries of a block."""
    listed = {name: [block[name][i] for i in rows.tolist()] for name in ("k", "filter_of", "limit")}
    return {**block, **listed, "ids": block["ids"].take(pa.array(rows)), "matrix": block["matrix"][rows]}


def screened(index: DataFrame, block: dict, opened: np.ndarray, kind: str, near=None, bound=None, bits: int = 0) -> Hits:
    """The best rows of the opened bands; of those that are only ``near`` rows whose codes
    differ from the query's in ``bound`` bits at most."""
    near = np.zeros_like(opened) if near is None else near
    bound = np.zeros(len(opened), np.int64) if bound is None else bound
    wanted = np.flatnonzero((opened | near).any(axis=0)).tolist()
    rows = index if len(wanted) == opened.shape[1] else index.filter(F.col("band").isin(wanted))
    coder = kernels.sign_coder(bits, block["matrix"].shape[1])
    codes, _ = kernels.as_matrix(coder(kernels.list_array(block["matrix"])), bits // kernels.WORD_BITS, None)
    screen = {"opened": opened, "near": near, "bound": bound, "codes": codes}
    return best_rows(rows, {**block, "screen": screen}, kind)


def last_distances(hits: DataFrame, block: dict) -> np.ndarray:
    """For each query the distance of its k-th hit, NaN where it has fewer: one row a query."""
    last = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    found = {row.query_id: row for row in last.collect()}
    asked = zip(block["ids"].to_pylist(), block["k"], strict=True)
    return np.array([found[i].d if i in found and found[i].n == k else np.nan for i, k in asked])


def approximate_hits(index: DataFrame, queries: DataFrame, tier: Tier, options: Options) -> Hits:
    """Ranked hits of every query, as ``nearest_hits`` but through the index."""
    kind, every = query_type(queries), 1 << tier.bands
    share = math.sqrt(tier.share)  # of the bands and of the codes, so that both hold

    def search(block: dict) -> Hits:
        places = band_places(block["matrix"], tier.bands)
        number = np.full(len(places), min(FIRST_BANDS, every))
        distance = np.full(len(places), np.nan)
        short = np.arange(len(places))
        while len(short):
            part = part_of(block, short)
            hits = screened(index, part, places[short] < number[short, None], kind, bits=tier.bits)
            distance[short] = last_distances(hits.frame, part)
            # Too few rows pass a query's filters: twice as many bands, up to all.
            short = short[np.isnan(distance[short]) & (number[short] < every)]
            number[short] = np.minimum(2 * number[short], every)
        opened, bounded = places < number[:, None], ~np.isnan(distance)
        known = np.where(bounded, distance, 0.0)
        near = near_bands(block["matrix"], known, tier.bands, share) & bounded[:, None]
        limit = np.where(bounded, distance + 2 * 10.0**-9, math.inf)
        block = {**block, "limit": limit.tolist()}
        return screened(index, block, opened, kind, near, bits_within(known, tier.bits, share), tier.bits)

    return by_block(queries, options, search, lambda: no_hits(index, kind))


def approximate_nearest(index: DataFrame, queries: DataFrame, tier: Tier, options: Options) -> DataFrame:
    return broadcast_keys(*approximate_hits(index, queries, tier, options))


# --- calibration ---------------------------------------------------------------------


def sample_papers(corpus: DataFrame, *columns: str) -> DataFrame:
    """A fixed sample of the corpus to calibrate with."""
    papers = corpus.filter(F.col("embedding").isNotNull()).select("paper_id", *columns)
    picked = papers.orderBy(F.xxhash64("paper_id"), "paper_id").limit(SAMPLE_QUERIES)
    return picked.withColumn("query_id", F.xxhash64("paper_id"))


def recall_by_share(
    index: DataFrame,
    queries: DataFrame,
    tier: Tier,
    options: Options,
    shares: tuple[float, ...],
    own: bool = False,
) -> DataFrame:
    """expected, neighbours, found, recall: what searches that aim at each share find.

    ``own`` says that the queries are papers of the corpus (see ``sample_papers``): a
    paper is no neighbour of itself then, as it would be found for nothing.
    """
    true = batch_nearest(index, queries, options).select("query_id", "paper_id")
    if own:
        true = true.filter(F.xxhash64("paper_id") != F.col("query_id"))

    def found(share: float) -> DataFrame:
        hits = approximate_nearest(index, queries, replace(tier, expected=share), options)
        return hits.select("query_id", "paper_id", F.lit(share).alias("expected"))

    each = reduce(DataFrame.unionByName, map(found, shares))
    wanted = true.select("*", F.explode(F.array(*map(F.lit, shares))).alias("expected"))
    met = wanted.join(each.withColumn("met", F.lit(1)), ["query_id", "paper_id", "expected"], "left")
    return (
        met.groupBy("expected")
        .agg(F.count("*").alias("neighbours"), F.count("met").alias("found"))
        .withColumn("recall", F.col("found") / F.col("neighbours"))
    )


def calibrated(index: DataFrame, queries: DataFrame, tier: Tier, options: Options, own: bool = False) -> Tier | None:
    """The tier with the least share to aim at that finds its target.

    None when none does: the caller then searches exactly. Tiers without a target keep
    their default, and where there is nothing to find there is nothing to miss.
    """
    if tier.target is None:
        return tier
    for share in (tier.share, *(s for s in STRICTER if s > tier.share)):
        row = recall_by_share(index, queries, tier, options, (share,), own).first()
        if row is None or row.recall >= tier.target:
            return replace(tier, expected=share)
    return None
