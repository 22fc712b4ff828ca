"""Continuous ingest of metadata records."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexivane.plans.ingest import ingest, write_rejects
from lexivane.sources.snapshot import with_split, write_sorted_out
from lexivane.sources.store import PaperStore


def read_snapshot_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_split(reader.load(folder))


def start_ingest(
    store: PaperStore,
    lines: DataFrame,
    checkpoint: str,
    name: str = "papers",
    written_at=None,
    embedder=None,
    rejects_to: str | None = None,
    trigger: dict | None = None,
    on_report: Callable[[dict], None] | None = None,
) -> StreamingQuery:
    """Parses, validates, embeds and upserts every micro-batch.

    The store notes the last batch of each named stream in the same pointer
    that publishes its rows, so a replayed batch changes nothing. Invalid papers and
    lines that are no records go to ``rejects_to/papers`` and ``rejects_to/lines``, by
    default below the store; ``on_report`` gets the report of every batch, with
    ``rejected``, ``bad_lines`` and what became of all lines. A batch is parsed once.
    Where the store has an index, codes are computed for the batch's papers and merged.
    """
    rejected_to = (rejects_to or f"{store.root}/rejects").rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.monotonically_increasing_id())
        folder = f"{store.root}/staging/{uuid.uuid4().hex}"
        try:
            papers, bad, outcomes = write_sorted_out(lines, folder, store.options.categories)
            bad_lines = write_rejects(bad.drop("line"), f"{rejected_to}/lines", (name, number))
            report = ingest(
                store,
                papers,
                written_at or datetime.now(timezone.utc),
                embedder=embedder,
                mode="quarantine",
                rebuild_index=False,
                rejects_to=f"{rejected_to}/papers",
                stream=(name, number),
                allow_empty=True,
            )
        finally:
            store.remove(folder)
        if on_report:
            on_report({**outcomes, **report, "bad_lines": bad_lines})

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
