"""The registered queries over the smallest tables, against SQL or their operators' brute force."""

from datetime import date

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registered
import compare
import corpus_pipeline
from lexivane.llm import queries, sql, urllists

from .test_exact import expected
from .test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.tables(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, FOLDER, name) is None


def test_jaccard_query(spark, texts):
    rows = queries.op9_jaccard_join(spark, FOLDER).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(texts)


def test_rollup_query(spark, con):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text, source, lang in con.execute("SELECT doc_id, text, source, lang FROM documents").fetchall():
        for kind in ("byte_bpe_50k", "words"):
            docs, tokens = want.get((source, lang, kind), (0, 0))
            if doc_id % 11:
                ids = len(tokenizer.encode(text, add_special_tokens=False).ids) + (doc_id % 7 == 0)
                docs, tokens = docs + 1, tokens + (ids if kind == "byte_bpe_50k" else len(text.split()))
            want[source, lang, kind] = (docs, tokens)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op6_token_rollup(spark, FOLDER).collect()}
    assert got == want


def test_pipeline_stages(spark, con):
    """Every stage against what it may drop, stage by stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        left[name] = docs.collect()
        docs = spark.createDataFrame(left[name], docs.schema)
    good = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r.doc_id for r in left["quality"]}
    assert sum(i in kept for i, q in good.items() if q) > 0.95 * sum(good.values())
    exact_rows = [(r.doc_id, r.text) for r in left["quality"]]
    assert {r.doc_id for r in left["exact_dedup"]} == {k[1] for k in expected(exact_rows)}
    near_rows = [(r.doc_id, r.text) for r in left["exact_dedup"]]
    assert {r.doc_id for r in left["near_dedup"]} == {c for _, _, c in brute(near_rows)}
    assert {r.doc_id for r in left["secrets"]} == {r.doc_id for r in left["near_dedup"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left["secrets"]}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


def test_many_moments_of_one_value_are_no_product(spark):
    """10,000 moments and 2,000 intervals of one value: rows are those of both sides."""
    starts = spark.range(2000).selectExpr("'spam' AS list", "'com' AS value", "id * 10 AS valid_from", "id * 10 + 4 AS valid_to")
    asked = spark.range(10_000).selectExpr("'com' AS value", "id * 2 AS fetched", "id AS n")
    active = urllists.active_at(asked, starts)
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Window" in plan
    assert {r.n for r in active.collect()} == {n for n in range(10_000) if n * 2 % 10 < 4}


def test_url_lists_edges(spark):
    entries = spark.createDataFrame(
        [
            ("spam", "bad.com", date(2024, 1, 10), "add"),
            ("spam", "bad.com", date(2024, 1, 10), "add"),
            ("spam", "bad.com", date(2024, 1, 20), "remove"),
            ("spam", "bad.com", date(2024, 2, 1), "add"),
            ("spam", "bad.com", date(2024, 2, 5), "remove"),
            ("spam", "bad.com", date(2024, 2, 5), "add"),
            ("page", "//ok.com/a", date(2024, 1, 1), "add"),
            ("spam", None, date(2024, 1, 1), "add"),
            (None, "ok.com", date(2024, 1, 1), "add"),
            ("spam", "ok.com", None, "add"),
            ("spam", "ok.com", date(2024, 1, 1), "other"),
        ],
        "list string, value string, dated date, action string",
    )
    cases = [
        ("http://bad.com/", date(2024, 1, 9), ""),
        ("http://bad.com/", date(2024, 1, 10), "spam"),
        ("HTTPS://u@WWW.Bad.com.:80/x?y#z", date(2024, 1, 19), "spam"),
        ("http://notbad.com/", date(2024, 1, 15), ""),
        ("http://bad.com/", date(2024, 1, 20), ""),
        ("http://bad.com/", date(2024, 2, 2), "spam"),
        ("http://bad.com/", date(2024, 2, 5), ""),
        ("http://ok.com/a/?q", date(2024, 1, 5), "page"),
        ("http://ok.com/b", date(2024, 1, 5), ""),
        (None, date(2024, 1, 15), ""),
        ("", date(2024, 1, 15), ""),
        ("http://bad.com/", None, ""),
        ("no address", date(2024, 1, 15), ""),
        ("http://bad.com/", date(2024, 1, 10), "spam"),
    ]
    captures = spark.createDataFrame([(i, u, f, "x", 1) for i, (u, f, _) in enumerate(cases)], "page_id long, url string, fetched date, lists string, n int")
    rows = urllists.verdicts(captures, entries).collect()
    assert {r.page_id: ",".join(r.lists) for r in rows} == {i: w for i, (_, _, w) in enumerate(cases)}
    assert all(r.blocked == bool(r.lists) for r in rows) and len(rows) == len(cases)
    assert urllists.verdicts(captures.limit(0), entries).count() == 0
    assert urllists.verdicts(captures, entries.limit(0)).filter("blocked").count() == 0
