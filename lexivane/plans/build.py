"""From a metadata snapshot to corpus files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lexivane.options import Options
from lexivane.session import configure, work_dir
from lexivane.sources.corpus_files import check_output, write_papers
from lexivane.sources.snapshot import files_in_order, first_of_files, positioned, read_snapshot, write_sorted_out


def build_corpus(
    spark: SparkSession,
    snapshot: str,
    output: str,
    options: Options | None = None,
    max_papers: int | None = None,
    form: str = "json",
    overwrite: bool = False,
    rejects_to: str | None = None,
    on_report: Callable[[dict], None] | None = None,
) -> int:
    """Writes the papers of the listed categories; how many there were.

    ``max_papers`` cuts them to the first ones; without it, there and in the options,
    all are written. Files are read in order until there are enough papers, each parsed
    once. Lines that are no records go to ``rejects_to``, by default a folder beside the
    output, with their place and fault; ``on_report`` gets what became of the lines of all
    files that were read.
    """
    configure(spark)
    options = options or Options()
    check_output(spark, output, overwrite)
    lines = read_snapshot(spark, snapshot)
    counts: Counter = Counter()
    rejected: list[DataFrame] = []

    def sorted_out(lines: DataFrame) -> DataFrame:
        papers, bad, outcomes = write_sorted_out(lines, work_dir(spark, "sorted-out"), options.categories)
        rejected.append(bad)
        counts.update(outcomes)
        return papers

    cap = options.max_papers if max_papers is None else max_papers
    if cap is None:
        papers = sorted_out(lines)
    else:
        files = files_in_order(lines)
        papers = first_of_files(files, lambda some: sorted_out(positioned(spark.read.text(some))), cap)
    written = write_papers(papers, output, form, overwrite)
    bad = reduce(DataFrame.unionByName, rejected)
    bad.write.mode("overwrite").parquet(rejects_to or f"{output.rstrip('/')}-rejects")
    if on_report:
        on_report({"written": written, **counts})
    return written
