"""Job options: the defaults and bounds every job shares."""

from __future__ import annotations

from dataclasses import dataclass

# The category codes a corpus build keeps by default.
DEFAULT_CATEGORIES = ("cs.AI", "cs.LG", "cs.CL")

# Bounds and default of the hits a request may ask for.
MIN_TOP_K, MAX_TOP_K, DEFAULT_TOP_K = 1, 50, 8
# Bounds and default of the vector length.
MIN_DIM, MAX_DIM, DEFAULT_DIM = 8, 4096, 384


@dataclass(frozen=True)
class Options:
    """Settings of one job.

    ``max_papers`` cuts a build or load to the first papers; without it all are taken.
    ``use_approximate`` lets searches go through the index of a store that has one.
    ``query_block_rows`` bounds what a search broadcasts: a larger query table
    is searched block by block (8192 vectors of 384 dimensions take 24 MB).
    ``buckets`` is fixed when a store is made; a bucket should hold about a
    gigabyte. ``index_budget_bytes`` bounds the sign codes of the approximate index
    (see ``operators.ann``).
    """

    embedding_dim: int = DEFAULT_DIM
    max_papers: int | None = None
    categories: tuple[str, ...] = DEFAULT_CATEGORIES
    use_approximate: bool = False
    buckets: int = 16
    query_block_rows: int = 8192
    index_budget_bytes: int = 1 << 40
    top_k: int = DEFAULT_TOP_K

    def __post_init__(self) -> None:
        _check("embedding_dim", self.embedding_dim, MIN_DIM, MAX_DIM)
        if self.max_papers is not None:
            check_cap(self.max_papers)
        _check("buckets", self.buckets, 1, 1 << 16)
        _check("query_block_rows", self.query_block_rows, 1, 1 << 16)
        check_top_k(self.top_k)


def _check(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")


def check_cap(rows: int) -> int:
    """A row cap as a caller gives it; zero and negative caps are refused."""
    if rows < 1:
        raise ValueError(f"max_papers must be 1 or more, got {rows}")
    return rows


def check_top_k(k: int) -> int:
    _check("top_k", k, MIN_TOP_K, MAX_TOP_K)
    return k
