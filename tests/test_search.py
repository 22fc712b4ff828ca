import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivane.functions import vectors as V
from lexivane.operators import grid, kernels
from lexivane.operators import search as search_module
from lexivane.operators.embed import ModelEmbedder, WordEmbedder, dimension_fault, embed
from lexivane.operators.predicates import search_predicate
from lexivane.operators.validate import category_filter
from lexivane.operators.search import batch_nearest, nearest, nearest_hits, result_rows, with_papers
from lexivane.options import Options

DIM = 8


def random_corpus(spark, rows=300, seed=1):
    """Vectors with exact copies, zero vectors, missing ones and one of another length."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(rows):
        vector = rng.normal(size=DIM).astype(np.float32).tolist()
        if i % 10 == 3:
            vector = data[i - 2][1]
        elif i % 50 == 7:
            vector = [0.0] * DIM
        elif i % 50 == 8:
            vector = None
        elif i % 50 == 9:
            vector = [1.0] * (DIM - 1)
        elif i % 50 == 11:
            vector = [None] + vector[1:]
        year = None if i % 9 == 0 else 1990 + i % 30
        category = None if i % 11 == 0 else f"cs.{'AB'[i % 2]}I s{i % 3}"
        data.append((f"p{i}", vector, year, category))
    df = spark.createDataFrame(data, "paper_id string, embedding array<float>, year int, category string")
    return data, df.repartition(5)


def brute_force(data, query, k, low=None, high=None, pattern=None):
    found = []
    for pid, vector, year, category in data:
        if vector is None or len(vector) != len(query) or None in vector:
            continue
        size = math.sqrt(sum(x * x for x in vector)) * math.sqrt(sum(x * x for x in query))
        if size == 0:
            continue
        if low is not None and (year is None or year < low):
            continue
        if high is not None and (year is None or year > high):
            continue
        if pattern is not None:
            if category is None or not any(
                all(p in ("_", c) for p, c in zip(pattern.upper(), category.upper()[at:]))
                for at in range(len(category) - len(pattern) + 1)
            ):
                continue
        distance = 1 - sum(x * y for x, y in zip(vector, query)) / size
        found.append((round(distance, 9), pid))
    return [pid for _, pid in sorted(found)[:k]]


FILTERS = [
    {},
    {"min_year": 2000},
    {"max_year": 2001},
    {"min_year": 1995, "max_year": 2010, "category": "c_.ai"},
    {"category": "S1"},
    {"category": "nothing"},
]


@pytest.mark.parametrize("filters", FILTERS)
def test_single_query_equals_brute_force(spark, filters):
    data, corpus = random_corpus(spark)
    query = data[1][1]
    found = [r.paper_id for r in nearest(corpus, query, 12, **filters).collect()]
    low, high = filters.get("min_year"), filters.get("max_year")
    assert found == brute_force(data, query, 12, low, high, filters.get("category"))


def query_frame(spark, data, count=40):
    rows = []
    usable = [d for d in data if d[1] and len(d[1]) == DIM and None not in d[1] and any(d[1])]
    for i in range(count):
        filters = FILTERS[i % len(FILTERS)]
        rows.append(
            (
                i,
                usable[i * 3][1],
                1 + i % 13,
                filters.get("min_year"),
                filters.get("max_year"),
                filters.get("category"),
            )
        )
    kinds = "query_id long, embedding array<float>, top_k int, min_year int, max_year int, category_contains string"
    return rows, spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize("block", [8192, 7])
def test_batch_equals_brute_force_in_any_block_size(spark, block):
    data, corpus = random_corpus(spark)
    rows, queries = query_frame(spark, data)
    hits = batch_nearest(corpus, queries, Options(query_block_rows=block)).collect()
    for qid, vector, k, low, high, pattern in rows:
        mine = sorted((h.rank, h.paper_id) for h in hits if h.query_id == qid)
        expected = brute_force(data, vector, k, low, high, pattern)
        assert mine == list(enumerate(expected, 1)), qid


def test_many_blocks_are_one_scan(spark, tmp_path):
    data, corpus = random_corpus(spark)
    corpus.write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    _, queries = query_frame(spark, data)
    hits = nearest_hits(stored, queries, Options(query_block_rows=7))
    plan = hits.frame._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "/corpus" in line for line in plan.splitlines()) == 1
    assert plan.count("payload") and hits.at_most == sum(1 + i % 13 for i in range(40))
    above = plan[: plan.index("MapInArrow")].count("Exchange hashpartitioning"), plan[plan.index("MapInArrow") :]
    assert "Exchange hashpartitioning" not in above[1]


def test_blocks_beyond_one_scan_and_filters_beyond_one_block(spark, monkeypatch):
    data, corpus = random_corpus(spark)
    _, queries = query_frame(spark, data)
    columns = ["query_id", "rank", "paper_id"]
    whole = sorted(batch_nearest(corpus, queries, Options()).select(columns).collect())
    monkeypatch.setattr(grid, "SCAN_BYTES", 3 * 7 * DIM * 8)
    monkeypatch.setattr(search_module, "BLOCK_FILTERS", 4)
    for seed in (None, corpus.filter("paper_id LIKE 'p1%'")):
        parts = batch_nearest(corpus, queries, Options(query_block_rows=7), seed)
        assert sorted(parts.select(columns).collect()) == whole


def test_small_slices_give_the_same(spark, monkeypatch):
    data, corpus = random_corpus(spark)
    _, queries = query_frame(spark, data)

    def ranked():
        hits = batch_nearest(corpus, queries, Options()).collect()
        return sorted((h.query_id, h.rank, h.paper_id, round(h.distance, 9)) for h in hits)

    whole = ranked()
    monkeypatch.setattr(kernels, "CELLS", 64)
    assert ranked() == whole


def test_no_queries_no_hits(spark):
    _, corpus = random_corpus(spark)
    queries = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert batch_nearest(corpus, queries, Options()).collect() == []


def test_all_copies_rank_by_id(spark):
    """A third of the corpus is one vector."""
    rows = [(f"c{i:04d}", [1.0, 0.0]) for i in range(400)] + [(f"d{i}", [0.5, float(i + 1)]) for i in range(800)]
    corpus = spark.createDataFrame(rows, "paper_id string, embedding array<float>").repartition(6)
    queries = spark.createDataFrame([(1, [2.0, 0.0], 50)], "query_id long, embedding array<float>, top_k int")
    hits = batch_nearest(corpus, queries, Options()).orderBy("rank").collect()
    assert [h.paper_id for h in hits] == [f"c{i:04d}" for i in range(50)]


def test_copies_that_pass_different_filters_are_kept_apart(spark):
    """Spare copies are left out before scoring, but not ones another filter wants."""
    rows = [(f"c{i:04d}", [1.0, 0.5], 1990 + i % 20, f"c{i % 3}") for i in range(900)]
    rows += [(f"d{i:04d}", [0.5, float(i % 9 + 1)], 1990 + i % 20, f"c{i % 3}") for i in range(900)]
    kinds = "paper_id string, embedding array<float>, year int, category string"
    corpus = spark.createDataFrame(rows, kinds).repartition(3)
    asked = [(q, [1.0, 0.5 + q / 10], 5, 1990 + q, 1995 + q, f"C{q % 3}") for q in range(9)]
    kinds = "query_id long, embedding array<float>, top_k int, min_year int, max_year int, category_contains string"
    hits = batch_nearest(corpus, spark.createDataFrame(asked, kinds), Options()).collect()
    data = [(p, v, y, c) for p, v, y, c in rows]
    for q, vector, k, low, high, pattern in asked:
        mine = [h.paper_id for h in sorted(hits, key=lambda h: h.rank) if h.query_id == q]
        assert mine == brute_force(data, vector, k, low, high, pattern)


def test_the_corpus_is_neither_shuffled_nor_read_for_texts(spark, tmp_path):
    _, corpus = random_corpus(spark)
    path = str(tmp_path / "corpus")
    corpus.withColumn("abstract", F.lit("long text")).write.parquet(path)
    queries = spark.createDataFrame([(1, [1.0] * DIM)], "query_id long, embedding array<float>")
    stored = spark.read.parquet(path)
    hits = batch_nearest(stored, queries, Options())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<paper_id:string,embedding:array<float>>" in plan
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below
    joined = with_papers(hits, stored, ["abstract"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined


def test_filters_of_all_queries_reach_the_scan(spark, tmp_path):
    data, corpus = random_corpus(spark)
    corpus.write.parquet(str(tmp_path / "corpus"))
    queries = spark.createDataFrame(
        [(1, [1.0] * DIM, 2000, 2005), (2, [1.0] * DIM, 2003, None)],
        "query_id long, embedding array<float>, min_year int, max_year int",
    )
    hits = batch_nearest(spark.read.parquet(str(tmp_path / "corpus")), queries, Options())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "Or(" in pushed and "GreaterThanOrEqual(year,2000)" in pushed and "GreaterThanOrEqual(year,2003)" in pushed


def test_single_query_is_a_top_k_plan_that_reads_texts_last(spark, tmp_path):
    _, corpus = random_corpus(spark)
    corpus.withColumn("abstract", F.lit("long text")).write.parquet(str(tmp_path / "corpus"))
    hits = nearest(spark.read.parquet(str(tmp_path / "corpus")), [1.0] * DIM, 5, min_year=2000)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
    below = plan[plan.index("MapInArrow") : plan.index("PushedFilters") + 200]
    assert "abstract" not in below and "GreaterThanOrEqual(year,2000)" in below


def test_queries_without_direction_have_no_hits(spark):
    _, corpus = random_corpus(spark)
    rows = [(1, [0.0] * DIM), (2, [1.0] * DIM), (3, None)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    hits = batch_nearest(corpus, queries, Options()).collect()
    assert {h.query_id for h in hits} == {2}


def test_query_ids_must_be_unique(spark):
    _, corpus = random_corpus(spark, 10)
    rows = [(1, [1.0] * DIM), (1, [2.0] * DIM)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="unique"):
        batch_nearest(corpus, queries, Options())


@pytest.mark.parametrize("k", [0, 51, 99])
def test_top_k_bounds(spark, k):
    _, corpus = random_corpus(spark, 10)
    with pytest.raises(ValueError):
        nearest(corpus, [1.0] * DIM, k)


def test_predicates():
    assert search_predicate() is None
    with pytest.raises(ValueError):
        search_predicate(2020, 2010)


def test_similarity(one):
    for distance, expected in [(0.0, 1.0), (1.0, 0.5), (0.25, 0.8), (-1e-9, 1.0)]:
        assert one(V.similarity(F.lit(distance)), x=1) == pytest.approx(expected)


def test_cosine_edges(one):
    def distance(a, b):
        a, b = (F.lit(a).cast("array<float>"), F.lit(b).cast("array<float>"))
        return one(V.cosine_distance(a, b), x=1)

    assert distance([1.0, 0.0], [0.0, 2.0]) == pytest.approx(1.0)
    assert distance([1.0, 1.0], [-2.0, -2.0]) == pytest.approx(2.0)
    assert distance([0.0, 0.0], [1.0, 2.0]) is None
    assert distance([1.0], [1.0, 2.0]) is None


def test_result_rows_fill_required_texts(spark):
    row = spark.createDataFrame(
        [("p", None, None, None, 2020, None, None, None, 0.25)],
        "paper_id string, title string, abstract string, authors string, year int, venue string, doi string, category string, distance double",
    )
    out = result_rows(row).first()
    assert (out.title, out.abstract, out.authors, out.year) == ("", "", None, 2020)
    assert out.similarity == pytest.approx(0.8)


# --- embedding ---------------------------------------------------------------------


def vectors_of(spark, texts, embedder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    rows = embed(df, embedder, text="t").orderBy("n").collect()
    return [r.embedding for r in rows]


def test_word_embedder(spark):
    a, b, c, d, e, f = vectors_of(
        spark, ["Deep, deep nets", "nets DEEP deep!", "", " .,- ", None, "été 深層 été"], WordEmbedder(64)
    )
    assert a == b and len(a) == 64
    assert sum(x * x for x in a) == pytest.approx(1.0, abs=1e-6)
    assert (c, d, e) == (None, None, None)
    assert sorted(abs(x) for x in f if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_embedding_does_not_depend_on_batching(spark, monkeypatch):
    texts = [f"word{i} word{i % 7} other" for i in range(200)]
    whole = vectors_of(spark, texts, WordEmbedder(16))
    monkeypatch.setattr(kernels, "CELLS", 64)
    assert vectors_of(spark, texts, WordEmbedder(16)) == whole


def test_model_embedder_normalizes_and_checks_the_dimension(spark):
    def load():
        return lambda texts: [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    got = vectors_of(spark, ["a", None, ""], ModelEmbedder(load, 2, "toy", batch_size=2))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:] == [None, None]
    with pytest.raises(Exception, match="expected 3"):
        vectors_of(spark, ["a"], ModelEmbedder(load, 3, "toy"))


def test_embedder_runs_once_under_a_filter(spark):
    df = spark.createDataFrame([("a",)], "t string")
    out = embed(df, WordEmbedder(8), text="t").filter("embedding IS NOT NULL")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_l2_normalize(one):
    unit = one(V.l2_normalize(F.lit([3.0, 4.0])), x=1)
    assert unit == pytest.approx([0.6, 0.8])
    assert one(V.l2_normalize(F.lit([0.0, 0.0])), x=1) is None


def test_dimension_fault(one):
    def fault(value):
        return one(dimension_fault(F.lit(value).cast("array<float>"), 2), x=1)

    assert fault([1.0, 2.0]) is None
    assert fault([1.0]) == "dimension"
    assert fault(None) == "missing"


# --- kernel properties ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_kernel_is_the_same_for_any_split_into_batches(data):
    """The best rows of the whole are among the best rows of its parts."""
    import pyarrow as pa

    n = data.draw(st.integers(1, 40))
    cell = st.integers(-2, 2)
    vectors = data.draw(st.lists(st.tuples(cell, cell, cell), min_size=n, max_size=n))
    queries = data.draw(st.lists(st.tuples(cell, cell, cell).filter(any), min_size=1, max_size=4))
    k = [data.draw(st.integers(1, 6)) for _ in queries]
    cut = data.draw(st.integers(0, n))
    block = {
        "ids": pa.array(range(len(queries))),
        "matrix": np.array(queries, dtype=float),
        "k": k,
        "filters": 0,
        "filter_of": [0] * len(queries),
        "limit": [math.inf] * len(queries),
    }
    batch = pa.RecordBatch.from_pydict(
        {
            "paper_id": [f"p{i:02d}" for i in range(n)],
            "passes": pa.nulls(n, pa.list_(pa.bool_())),
            "embedding": pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32())),
        }
    )
    run = kernels.nearest_rows(block, 3)

    def found(batches):
        out = [b.to_pydict() for b in run(iter(batches))]
        return sorted(
            (q, p) for b in out for q, p in zip(b["query_id"], b["paper_id"], strict=True)
        )

    expected = []
    for qid, query in enumerate(queries):
        rows = [(f"p{i:02d}", list(map(float, v)), None, None) for i, v in enumerate(vectors)]
        expected += [(qid, p) for p in brute_force(rows, list(map(float, query)), k[qid])]
    parts = [b for b in (batch.slice(0, cut), batch.slice(cut)) if b.num_rows]
    assert found([batch]) == found(parts) == sorted(expected)


def test_large_query_tables_are_searched_in_parts(spark):
    """Parts, and blocks of few filters, give what one block gives."""
    _, corpus = random_corpus(spark)
    rows = [(i, [float(i % 5), 1.0, *[float(i % 3)] * (DIM - 2)], 3, 1990 + i % 9) for i in range(60)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>, top_k int, min_year int")
    whole = batch_nearest(corpus, queries, Options()).collect()
    parts = batch_nearest(corpus, queries, Options(query_block_rows=7)).collect()
    assert sorted(whole, key=str) == sorted(parts, key=str)
    twice = queries.unionByName(queries.limit(1))
    with pytest.raises(ValueError, match="unique"):
        batch_nearest(corpus, twice, Options(query_block_rows=7))
    mixed = queries.unionByName(spark.createDataFrame([(99, [1.0], 3, None)], queries.schema))
    with pytest.raises(ValueError, match="length"):
        batch_nearest(corpus, mixed, Options(query_block_rows=7))


def test_embedding_holds_slices_not_batches(monkeypatch):
    """What a batch takes besides itself does not grow with it; slices and parts change nothing."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(500)])
    texts = [" ".join(words[rng.integers(0, 500, 300)]) for _ in range(2000)]
    texts += [None, "", " .,- ", " ".join(words[rng.integers(0, 500, 30_000)])]
    batch = pa.array(texts, pa.string())
    whole = kernels.word_embedder(16)(batch)
    monkeypatch.setattr(kernels, "TEXT_BYTES", 1 << 16, raising=False)
    before, pool = pa.default_memory_pool(), pa.system_memory_pool()  # used by nothing else
    pa.set_memory_pool(pool)
    try:
        sliced = kernels.word_embedder(16)(batch)
        peak = pool.max_memory()
    finally:
        pa.set_memory_pool(before)
    assert sliced.equals(whole)
    assert whole.is_null().to_pylist() == [not (t or "").strip(" .,-") for t in texts]
    assert peak < batch.nbytes / 2


def test_words_beyond_what_an_embedder_remembers(monkeypatch):
    texts = pa.array([f"a{i} b{i % 9} {'long' * 30}{i % 3}" for i in range(400)])
    whole = kernels.word_embedder(32)(texts)
    monkeypatch.setattr(kernels, "TEXT_BYTES", 500, raising=False)
    monkeypatch.setattr(kernels, "CACHED_WORDS", 20, raising=False)
    assert kernels.word_embedder(32)(texts).equals(whole)


def test_scoring_holds_slices_not_batches(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 32)).astype(np.float32)
    vectors[::3] = vectors[0]
    batch = pa.RecordBatch.from_pydict(
        {
            "paper_id": [f"p{i:05d}" for i in range(len(vectors))],
            "passes": pa.nulls(len(vectors), pa.list_(pa.bool_())),
            "embedding": kernels.list_array(vectors),
        }
    )
    block = {"ids": pa.array([0, 1]), "matrix": vectors[:2].astype(float), "k": [5, 3], "filters": 0}
    block |= {"filter_of": [0, 0], "limit": [math.inf] * 2}

    def found():
        (hits,) = kernels.nearest_rows(block, 32)(iter([batch]))
        rows = zip(*(hits.column(n).to_pylist() for n in ("query_id", "paper_id", "distance")), strict=True)
        return sorted((q, p, round(d, 9)) for q, p, d in rows)

    whole = found()
    assert [p for q, p, _ in whole if q == 0] == [f"p{3 * i:05d}" for i in range(5)]
    monkeypatch.setattr(kernels, "CELLS", 1 << 14)
    tracemalloc.start()
    sliced = found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sliced == whole and peak < vectors.nbytes
