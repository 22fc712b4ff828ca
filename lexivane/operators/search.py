"""Exact nearest-neighbour search by cosine distance.

Queries are searched in blocks: every task scores its rows against the whole
block and keeps only the best k per query, so no pair of query and paper leaves
a task unless it may be in the result. A single query is a block of one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivane.functions import vectors as V
from lexivane.operators import grid, kernels
from lexivane.operators.planning import broadcast_keys, fits_broadcast
from lexivane.operators.predicates import search_predicate
from lexivane.options import Options, check_top_k
from lexivane.session import work_dir

RESULT_TEXT = ["title", "abstract", "authors", "year", "venue", "doi", "category"]
QUERY_TYPES = {"embedding": "array<float>", "top_k": "int", "min_year": "int", "max_year": "int", "category_contains": "string"}
QUERY_COLUMNS = ["query_id", *QUERY_TYPES]
HITS = "query_id {query_id}, wanted bigint, paper_id {paper_id}, distance double"
MERGE_SALTS = 32
# Different filters one block of queries may have.
BLOCK_FILTERS = 64


def nearest(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    buckets: int | None = None,
    **filters: int | str | None,
) -> DataFrame:
    """The k papers nearest to one query vector, filters applied first.

    Papers without a usable vector are not searchable. Only ids, vectors and
    filter columns are read of all papers, the other columns of the k found.
    """
    block = {
        "ids": pa.array([0]),
        "matrix": np.array([query], dtype=np.float64),
        "k": [check_top_k(k)],
        "distinct": [tuple(filters.get(name) for name in ("min_year", "max_year", "category"))],
        "filter_of": [0],
        "limit": [math.inf],
    }
    scored = score_block(corpus, block, "bigint")
    order = [V.rank_key(F.col("distance")), F.col("paper_id")]
    hits = scored.select("paper_id", "distance").orderBy(*order).limit(k)
    columns = [c for c in corpus.columns if c not in ("paper_id", "bucket")]
    return with_papers(broadcast_keys(hits, k), corpus, columns, buckets).orderBy(*order)


def result_rows(hits: DataFrame) -> DataFrame:
    """Result form: required texts never null, similarity next to the distance."""
    required = {"paper_id", "title", "abstract"}
    fields = [
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in required else F.col(c)
        for c in ["paper_id", *RESULT_TEXT]
    ]
    lead = [c for c in ("query_id", "rank") if c in hits.columns]
    return hits.select(
        *lead, *fields, "distance", V.similarity(F.col("distance")).alias("similarity")
    )


def query_blocks(queries: DataFrame, options: Options) -> Iterator[dict]:
    """The query table in blocks of about ``query_block_rows``, each of few filters.

    A table of one block is fetched at once. A larger one is written to the work folder
    in parts by a hash of the query id; a part is one block. Equal ids fall into one
    part, where they are refused.
    """
    size = options.query_block_rows
    columns = [c if c in queries.columns else F.lit(None).alias(c) for c in QUERY_COLUMNS]
    usable = queries.select(*columns).filter("embedding IS NOT NULL")
    head = usable.limit(size + 1).toArrow()
    if head.num_rows <= size:
        tables = iter([head])
    else:
        tables = _staged_parts(usable, size)
    for table in tables:
        yield from query_block(table, options)


def _staged_parts(usable: DataFrame, size: int) -> Iterator[pa.Table]:
    spark = usable.sparkSession
    folder, parted = (work_dir(spark, name) for name in ("queries", "query-parts"))
    usable.write.parquet(folder)
    written = spark.read.schema(usable.schema).parquet(folder)
    widths = written.agg(
        F.count("*").alias("rows"), F.min(F.size("embedding")), F.max(F.size("embedding"))
    ).first()
    if widths[1] != widths[2]:
        raise ValueError("query vectors differ in length")
    # Parts differ in size; a quarter less on average keeps nearly all within a block.
    parts = -(-4 * widths.rows // (3 * size))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    written.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(parted)
    rows = spark.read.schema(f"{_ddl(usable)}, part bigint").parquet(parted)
    for number in range(parts):
        yield rows.filter(F.col("part") == number).drop("part").toArrow()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def query_block(table: pa.Table, options: Options) -> Iterator[dict]:
    """The queries of a part as arrays; none when none has a direction.

    More filters than ``BLOCK_FILTERS`` make several blocks, as each filter is a column
    expression of the scan.
    """
    if not table.num_rows:
        return
    vectors = table.column("embedding").combine_chunks()
    matrix, at = kernels.as_matrix(vectors, len(vectors[0]), np.float64)
    if len(at) < table.num_rows:
        raise ValueError("query vectors differ in length")
    ids = table.column("query_id").to_pylist()
    if len(set(ids)) < len(ids):
        raise ValueError("query ids are not unique")
    usable = np.flatnonzero(matrix.any(axis=1) & ~np.isnan(matrix).any(axis=1)).tolist()
    column = {name: table.column(name).to_pylist() for name in QUERY_COLUMNS if name != "embedding"}
    filters = list(zip(column["min_year"], column["max_year"], column["category_contains"], strict=True))
    distinct = sorted({filters[i] for i in usable}, key=repr)
    for start in range(0, len(distinct), BLOCK_FILTERS):
        own = {f: place for place, f in enumerate(distinct[start : start + BLOCK_FILTERS])}
        rows = [i for i in usable if filters[i] in own]
        yield {
            "ids": table.column("query_id").combine_chunks().take(pa.array(rows)),
            "matrix": matrix[rows],
            "limit": [math.inf] * len(rows),
            "k": [column["top_k"][i] or options.top_k for i in rows],
            "distinct": list(own),
            "filter_of": [own[filters[i]] for i in rows],
        }


def filtered(corpus: DataFrame, distinct: list[tuple]) -> tuple[DataFrame, Column, int]:
    """Rows some filter of a block lets pass, which ones do, and how many filters there are.

    Filters are column expressions: their alternative is pushed to the scan.
    """
    each = [search_predicate(*f) for f in distinct]
    if all(p is None for p in each):
        return corpus, F.lit(None).cast("array<boolean>"), 0
    passes = F.array(*[F.lit(True) if p is None else F.coalesce(p, F.lit(False)) for p in each])
    if any(p is None for p in each):
        return corpus, passes, len(each)
    return corpus.filter(reduce(or_, each)), passes, len(each)


def score_block(corpus: DataFrame, block: dict, query_type: str) -> DataFrame:
    """The best rows of every task, not yet merged."""
    id_type = corpus.schema["paper_id"].dataType.simpleString()
    hits = HITS.format(query_id=query_type, paper_id=id_type)
    width = block["matrix"].shape[1]
    rows, passes, filters = filtered(corpus, block["distinct"])
    kernel = kernels.nearest_rows({**block, "filters": filters}, width)
    screen = ["band", "code"] if "screen" in block else []
    return rows.select("paper_id", passes.alias("passes"), "embedding", *screen).mapInArrow(kernel, hits)


def best_per_query(hits: DataFrame, deepest: int) -> DataFrame:
    """The best hits of every query, ranked; ``wanted`` says how many it asked for.

    Merged in two steps: a query's hits are first cut down in ``MERGE_SALTS``
    groups, so the last step sees at most ``deepest * MERGE_SALTS`` rows.
    """
    order = [V.rank_key(F.col("distance")), F.col("paper_id")]
    salt = F.pmod(F.xxhash64("paper_id"), F.lit(MERGE_SALTS))
    salted = Window.partitionBy("query_id", "salt").orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    return (
        hits.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(salted))
        .filter(F.col("rank") <= deepest)
        .withColumn("rank", F.row_number().over(whole))
        .filter((F.col("rank") <= deepest) & (F.col("rank") <= F.col("wanted")))
        .select("query_id", "rank", "paper_id", "distance")
    )


class Hits(NamedTuple):
    """Ranked hits (query_id, rank, paper_id, distance) and a bound on their number."""

    frame: DataFrame
    at_most: int


def by_block(
    queries: DataFrame, options: Options, search: Callable[[dict], Hits], none: Callable
) -> Hits:
    """Searches a query table in blocks.

    A table of one block is one lazy plan. A larger one is searched block by
    block, each block's hits written to the work folder before the next one is
    read, so that the driver holds one block at any time.
    """
    blocks = query_blocks(queries, options)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return Hits(none(), 0)
    if second is None:
        return search(first)
    spark = queries.sparkSession
    folder, rows = work_dir(spark, "hits"), 0
    for number, block in enumerate(itertools.chain([first, second], blocks)):
        hits = search(block)
        hits.frame.write.parquet(f"{folder}/block={number}")
        rows += hits.at_most
    return Hits(spark.read.parquet(folder).drop("block"), rows)


def best_rows(
    corpus: DataFrame,
    block: dict,
    query_type: str,
    seed: DataFrame | None = None,
) -> Hits:
    """The best rows of the corpus for every query of a block.

    ``seed`` is a small part of the corpus that is searched first. Its k-th best
    bounds the k-th best of the whole, so most tasks of the whole search then
    have nothing to hand on. The result is the same.
    """

    def best(rows: DataFrame, block: dict) -> DataFrame:
        hits = score_block(rows, block, query_type)
        return best_per_query(hits, max(block["k"]))

    if seed is not None:
        block = {**block, "limit": limits(best(seed, block), block)}
    return Hits(best(corpus, block), sum(block["k"]))


def no_hits(corpus: DataFrame, query_type: str) -> DataFrame:
    id_type = corpus.schema["paper_id"].dataType.simpleString()
    fields = f"query_id {query_type}, rank int, paper_id {id_type}, distance double"
    return corpus.sparkSession.createDataFrame([], fields)


def limits(hits: DataFrame, block: dict) -> list[float]:
    """For each query of a block the distance of its last wanted hit, if it has so many."""
    last = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    found = {row.query_id: row for row in last.collect()}
    return [
        found[i].d + 2 * 10.0**-V.RANK_DECIMALS if i in found and found[i].n == k else math.inf
        for i, k in zip(block["ids"].to_pylist(), block["k"], strict=True)
    ]


def query_type(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def nearest_hits(
    corpus: DataFrame, queries: DataFrame, options: Options, seed: DataFrame | None = None
) -> Hits:
    """The top_k nearest papers of every query under that query's own filters."""
    kind = query_type(queries)
    columns = [F.col(c) if c in queries.columns else F.lit(None).cast(t).alias(c) for c, t in QUERY_TYPES.items()]
    usable = queries.select("query_id", *columns).filter("embedding IS NOT NULL")
    head = usable.limit(options.query_block_rows + 1).toArrow()
    if head.num_rows > options.query_block_rows:
        return _grid_nearest(corpus, usable, options, seed)
    blocks = list(query_block(head, options))
    if not blocks:
        return Hits(no_hits(corpus, kind), 0)
    each = [best_rows(corpus, block, kind, seed=seed) for block in blocks]
    return Hits(reduce(DataFrame.unionByName, [h.frame for h in each]), sum(h.at_most for h in each))


def _grid_nearest(corpus: DataFrame, usable: DataFrame, options: Options, seed: DataFrame | None) -> Hits:
    """The same for a table of many blocks, see ``grid``."""
    path = work_dir(usable.sparkSession, "queries")
    usable.write.parquet(path)
    queries = usable.sparkSession.read.schema(usable.schema).parquet(path)
    if not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query ids are not unique")
    wanted = F.coalesce("top_k", F.lit(options.top_k))
    sums = queries.agg(F.max(wanted).alias("deepest"), F.sum(wanted).alias("hits")).first()
    id_type = corpus.schema["paper_id"].dataType.simpleString()
    kinds = HITS.format(query_id=query_type(queries), paper_id=id_type)
    distinct = grid.distinct_filters(queries)
    found = []
    for start in range(0, len(distinct), BLOCK_FILTERS):
        filters = distinct[start : start + BLOCK_FILTERS]
        own = queries
        if len(distinct) > BLOCK_FILTERS:
            chosen = queries.sparkSession.createDataFrame(filters, queries.select(*grid.FILTER).schema)
            own = queries.join(F.broadcast(chosen), [queries[c].eqNullSafe(chosen[c]) for c in grid.FILTER], "left_semi")

        def best(rows: DataFrame, filters: list, own: DataFrame, limits: DataFrame | None) -> DataFrame:
            blocks, scans, width = grid.write_blocks(own, filters, options, limits)
            rows, passes, number = filtered(rows, filters)
            each = [grid.grid_hits(rows, passes, number, blocks, scan, width, kinds) for scan in range(scans)]
            return best_per_query(reduce(DataFrame.unionByName, each), sums.deepest)

        limits = None
        if seed is not None:
            limits = grid.limits_from(best(seed, filters, own, None), own, options, 2 * 10.0**-V.RANK_DECIMALS)
        found.append(best(corpus, filters, own, limits))
    return Hits(reduce(DataFrame.unionByName, found), sums.hits)


def batch_nearest(
    corpus: DataFrame, queries: DataFrame, options: Options, seed: DataFrame | None = None
) -> DataFrame:
    """``nearest_hits``, marked for broadcast when their number, the sum of all top_k, is small."""
    return broadcast_keys(*nearest_hits(corpus, queries, options, seed))


def bucket_of(paper_id: Column, buckets: int) -> Column:
    """The bucket Spark's own bucketing puts an id into."""
    return F.pmod(F.hash(paper_id), F.lit(buckets)).cast("int")


def with_papers(
    hits: DataFrame,
    corpus: DataFrame,
    columns: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Hits joined back to the columns a result shows.

    Texts are read only here, for the few papers that were found. For a stored
    corpus the join also runs on the bucket, which prunes folders at run time.
    """
    columns = columns or RESULT_TEXT
    if buckets is None:
        return hits.join(corpus.select("paper_id", *columns), "paper_id")
    keyed = hits.withColumn("bucket", bucket_of(F.col("paper_id"), buckets))
    papers = corpus.select("bucket", "paper_id", *columns)
    return keyed.join(papers, ["bucket", "paper_id"]).drop("bucket")


def with_stored_papers(hits: Hits, corpus: DataFrame, bucketed: DataFrame, buckets: int) -> DataFrame:
    """``with_papers`` from a store: few hits are broadcast; many are dealt by id to the
    buckets of the corpus, whose texts are not shuffled either."""
    if fits_broadcast(hits.at_most):
        return with_papers(F.broadcast(hits.frame), corpus, buckets=buckets)
    return hits.frame.hint("shuffle_hash").join(bucketed.select("paper_id", *RESULT_TEXT), "paper_id")
