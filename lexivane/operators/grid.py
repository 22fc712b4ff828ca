"""Query tables larger than a block: a grid of query blocks and corpus splits in one scan.

Queries are packed into blocks by Spark tasks, a row per block, and written. The blocks a
scan can carry are broadcast and joined to the first row of every split, so that a task
reads its rows once, scores them against all blocks in turn and hands on the best k per
query. No query passes through Python on the driver, and no corpus row is moved. What is
broadcast is bounded by ``SCAN_BYTES``; a query table of more bytes takes a scan for each
so many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.operators import kernels
from lexivane.options import Options
from lexivane.session import work_dir

# Vectors of the blocks that one scan carries, and what a number of them takes.
SCAN_BYTES = 64 << 20
NUMBER_BYTES = 8
FILTER = ["min_year", "max_year", "category_contains"]
FIRST_ROW = (1 << 33) - 1
# Sizes of blocks vary with the hash that deals the queries.
FULLNESS = 0.75


def write_blocks(queries: DataFrame, filters: list[tuple], options: Options, limits: DataFrame | None) -> tuple[str, int, int]:
    """Written rows ``scan, block, payload``; the number of scans and of dimensions.

    ``limits`` (query_id, limit) bounds the distance a query's hits may have.
    """
    spark = queries.sparkSession
    sizes = queries.agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes.low != sizes.high:
        raise ValueError("query vectors differ in length")
    blocks = math.ceil(sizes.rows / (FULLNESS * options.query_block_rows))
    per_scan = max(1, SCAN_BYTES // (options.query_block_rows * sizes.high * NUMBER_BYTES))
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in FILTER)
    numbered = spark.createDataFrame([(*f, i) for i, f in enumerate(filters)], f"{kinds}, filter_of int")
    same = [queries[c].eqNullSafe(numbered[c]) for c in FILTER]
    told = queries.join(F.broadcast(numbered), same).select(
        "query_id",
        "embedding",
        F.coalesce("top_k", F.lit(options.top_k)).cast("long").alias("k"),
        "filter_of",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
    )
    none = F.lit(math.inf)
    told = told.withColumn("limit", none) if limits is None else told.join(limits, "query_id", "left").fillna(math.inf, ["limit"])
    packed = told.groupBy("block").applyInArrow(kernels.packed_block, "block long, payload binary")
    path = work_dir(spark, "query-blocks")
    packed.withColumn("scan", F.floor(F.col("block") / per_scan).cast("int")).write.partitionBy("scan").parquet(path)
    return path, -(-blocks // per_scan), sizes.high


def grid_hits(corpus: DataFrame, passes: Column, filters: int, path: str, scan: int, width: int, kinds: str) -> DataFrame:
    """The best rows of every split for all blocks of a scan, not yet merged."""
    spark = corpus.sparkSession
    blocks = spark.read.parquet(path).filter(F.col("scan") == scan).select(F.lit(0).alias("lead"), "payload")
    first = F.when(F.monotonically_increasing_id().bitwiseAND(FIRST_ROW) == 0, 0).alias("lead")
    rows = corpus.select("paper_id", passes.alias("passes"), "embedding", first)
    carried = rows.join(F.broadcast(blocks), "lead", "left").select("paper_id", "passes", "embedding", "payload")
    return carried.mapInArrow(kernels.grid_rows(filters, width), kinds)


def limits_from(hits: DataFrame, queries: DataFrame, options: Options, slack: float) -> DataFrame:
    """``query_id, limit``: the distance of a query's last wanted hit, where it has so many."""
    last = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    wanted = queries.select("query_id", F.coalesce("top_k", F.lit(options.top_k)).alias("k"))
    return last.join(wanted, "query_id").filter("n = k").select("query_id", (F.col("d") + slack).alias("limit"))


def distinct_filters(queries: DataFrame) -> list[tuple]:
    """The different filters of a query table, in a fixed order."""
    return sorted((tuple(r) for r in queries.select(*FILTER).distinct().collect()), key=repr)
