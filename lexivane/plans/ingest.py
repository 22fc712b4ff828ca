"""From papers to the stored, embedded, indexed corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexivane import schema
from lexivane.functions import text as X
from lexivane.operators import ann
from lexivane.operators.embed import WordEmbedder, embed
from lexivane.operators.validate import valid_papers, validate_papers
from lexivane.sources.corpus_files import read_papers
from lexivane.sources.snapshot import POSITION, first_rows
from lexivane.sources.store import PaperStore

OPTIONAL_TEXT = ["authors", "venue", "doi", "category"]


def empty_to_null(papers: DataFrame) -> DataFrame:
    return papers.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in OPTIONAL_TEXT})


def with_combined_text(papers: DataFrame) -> DataFrame:
    return papers.withColumn("combined_text", X.combined_text(F.col("title"), F.col("abstract")))


def embedded(papers: DataFrame, embedder) -> DataFrame:
    """Papers ready to store. Vectors always come from the text, never from the input."""
    return embed(with_combined_text(empty_to_null(papers)), embedder)


def _upsert(store: PaperStore, papers: DataFrame, written_at, embedder, order, **options) -> dict:
    state = store.pointer()
    dim = state.dim if state else store.options.embedding_dim
    embedder = embedder or WordEmbedder(dim)
    if embedder.dim != dim:
        raise ValueError(f"the embedder gives {embedder.dim} dimensions, the store has {dim}")
    rows = papers.select(*schema.PAPER_COLUMNS, *order)
    prepare = lambda df: embedded(df, embedder)
    return store.upsert(rows, written_at, order, prepare, model=embedder.name, **options)


def _counted(papers: DataFrame) -> tuple[DataFrame, Observation]:
    """All papers, and how many of them break a rule, known when they have been written."""
    broken = Observation()
    seen = validate_papers(papers).observe(broken, F.count_if(F.size("reasons") > 0).alias("rows"))
    return seen.drop("reasons"), broken


def title_queries(store: PaperStore, embedder) -> DataFrame:
    """Titles of some papers as search queries, to calibrate an index with."""
    titles = ann.sample_papers(store.sample() or store.papers(), "title")
    return embed(titles, embedder or WordEmbedder(store.pointer().dim), text="title")


def build_index(
    store: PaperStore, embedder=None, skip: bool = False, rebuild: bool = False
) -> bool:
    if not store.exists():
        return False
    return store.build_index(title_queries(store, embedder), skip, rebuild, own=True)


def ingest(
    store: PaperStore,
    papers: DataFrame,
    written_at,
    embedder=None,
    mode: str = "fail",
    rebuild_index: bool = True,
    order: list[str] | None = None,
    rejects_to: str | None = None,
    **upsert,
) -> dict:
    """Validates, embeds and upserts a batch, then makes sure there is an index.

    ``order`` names the columns that tell which of several rows of one id is the
    last. In ``keep`` mode invalid papers are stored like others and counted as ``invalid``.
    In ``quarantine`` mode they go to the folder ``rejects_to``, by
    default below the store, with their reasons, and are counted; a batch of a stream
    has a folder of its own, so that its replay writes them once.
    """
    rejected, folder, broken = 0, None, None
    if mode == "quarantine":
        folder = f"{store.root}/staging/{uuid.uuid4().hex}"
        validate_papers(papers).write.parquet(folder)
        checked = store.spark.read.parquet(folder)
        valid = checked.filter(F.size("reasons") == 0).drop("reasons")
        rejected = write_rejects(
            checked.filter(F.size("reasons") > 0), rejects_to or f"{store.root}/rejects/papers", upsert.get("stream")
        )
    elif mode == "keep":
        valid, broken = _counted(papers)
    else:
        valid = valid_papers(papers, mode)
    try:
        report = _upsert(store, valid, written_at, embedder, order or POSITION, **upsert)
    finally:
        if folder:
            store.remove(folder)
    if broken is not None and "rows_in" in report:  # else the batch was not read
        report["invalid"] = broken.get["rows"]
    indexed = build_index(store, embedder) if rebuild_index else store.index() is not None
    return {**report, "rejected": rejected, "vector_index": "ok" if indexed else "skipped"}


def write_rejects(rows: DataFrame, folder: str, stream: tuple[str, int] | None = None) -> int:
    """Writes rejected rows into a folder of this batch; how many there were."""
    batch = f"{stream[0]}-{stream[1]}" if stream else uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/batch={batch}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def load_corpus(
    store: PaperStore,
    path: str,
    written_at,
    form: str = "json",
    max_papers: int | None = None,
    replace: bool = False,
    skip_index: bool = False,
    embedder=None,
    mode: str = "fail",
) -> dict:
    """Loads corpus files: all papers are validated, then taken, or the first ``max_papers``
    where that is set here or in the options. ``mode`` is ``fail`` or ``keep``, see ``ingest``.

    With ``replace`` the stored papers and the index go; should the load fail,
    they stay.
    """
    cap = store.options.max_papers if max_papers is None else max_papers
    if mode not in ("fail", "keep"):
        raise ValueError(f"unknown mode {mode}")
    papers = read_papers(store.spark, path, form)
    papers, broken = _counted(papers) if mode == "keep" else (valid_papers(papers), None)
    papers = papers if cap is None else first_rows(papers, cap)
    report = _upsert(store, papers, written_at, embedder, POSITION, replace_all=replace)
    if broken is not None:
        report["invalid"] = broken.get["rows"]
    indexed = build_index(store, embedder, skip=skip_index)
    return {**report, "vector_index": "ok" if indexed else "skipped"}
