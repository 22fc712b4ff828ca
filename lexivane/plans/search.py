"""From search requests to responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators import ann
from lexivane.operators.embed import WordEmbedder, embed
from lexivane.operators.profile import corpus_profile
from lexivane.operators.search import nearest_hits, result_rows, with_stored_papers
from lexivane.operators.validate import validate_requests
from lexivane.sources.store import PaperStore

ENGINE = "Spark cosine search"
PATH_TAKEN = "approximate"


def accepted(requests: DataFrame) -> DataFrame:
    return validate_requests(requests).filter(F.size("reasons") == 0).drop("reasons")


def embedded_requests(requests: DataFrame, embedder) -> DataFrame:
    return embed(accepted(requests), embedder, text="query")


def search(store: PaperStore, requests: DataFrame, embedder=None) -> DataFrame:
    """Results of all accepted requests, ranked, with the path that was taken.

    The approximate path is taken when the options ask for it and the store has an
    index. An empty corpus and an embedder of another dimension than the stored
    vectors are errors, not empty results.
    """
    state = store.pointer()
    if state is None or state.rows == 0:
        raise ValueError("the corpus is empty; load papers first")
    embedder = embedder or WordEmbedder(state.dim)
    if embedder.dim != state.dim:
        raise ValueError(f"the embedder gives {embedder.dim} dimensions, the store has {state.dim}")
    queries, papers, options = embedded_requests(requests, embedder), store.papers(state), store.options
    approximate = options.use_approximate and state.index is not None
    if approximate:
        hits = ann.approximate_hits(store.codes(state), queries, store.tier(state), options)
    else:
        hits = nearest_hits(papers, queries, options, store.sample(state))
    found = result_rows(with_stored_papers(hits, papers, store.bucketed(state), state.buckets))
    path = F.lit(approximate).alias("approximate", metadata={PATH_TAKEN: approximate})
    return found.select("*", path)


def profile(store: PaperStore) -> DataFrame:
    """One row about the stored corpus: its counts from the rows, the rest as the store notes it."""
    state = store.pointer()
    if state is None:
        raise ValueError("there is no corpus")
    indexed, wanted = state.index is not None, store.options.use_approximate
    return corpus_profile(store.papers(state), state.model, state.dim, indexed, wanted)


def responses(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One row per request: its echo, the path ``search`` took and its ranked results.

    The path is part of the results' schema, so it is known for requests without hits
    too. A result list holds at most top_k entries, so each group is small.
    """
    approximate = results.schema["approximate"].metadata[PATH_TAKEN]
    columns = [c for c in results.columns if c not in ("query_id", "approximate")]
    ranked = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"]))).alias(
            "results"
        )
    )
    no_results = F.array().cast(ranked.schema["results"].dataType)
    return (
        requests.select(
            "query_id", "query", "top_k", "min_year", "max_year", "category_contains"
        )
        .join(ranked, "query_id", "left")
        .withColumns(
            {
                "engine": F.lit(ENGINE),
                "approximate": F.lit(approximate),
                "results": F.coalesce("results", no_results),
            }
        )
    )


