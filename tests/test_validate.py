import pytest
from pyspark.errors import PySparkException

from lexivane import schema
from lexivane.operators.validate import rejected_papers, valid_papers, validate_papers, validate_requests
from lexivane.options import Options

PAPER = dict(
    paper_id="p", title="T", abstract="A", authors=None, year=None, venue=None, doi=None, category=None
)


def paper_frame(spark, *changes):
    rows = [tuple((PAPER | c).values()) for c in changes]
    return spark.createDataFrame(rows, schema.PAPER_IN)


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, []),
        ({"paper_id": None}, ["paper_id missing"]),
        ({"paper_id": "x" * 64}, []),
        ({"paper_id": "x" * 65}, ["paper_id too long"]),
        ({"title": ""}, ["title missing"]),
        ({"title": "é" * 4000}, []),
        ({"title": "t" * 4001}, ["title too long"]),
        ({"title": "  "}, []),
        ({"title": "  ", "abstract": "  "}, ["text blank"]),
        ({"abstract": None, "year": 1499}, ["abstract missing", "year out of range"]),
        ({"year": 1500}, []),
        ({"year": 2101}, ["year out of range"]),
        ({"authors": "a" * 2001, "venue": "v" * 501}, ["authors too long", "venue too long"]),
        ({"doi": "d" * 257, "category": "c" * 501}, ["doi too long", "category too long"]),
    ],
)
def test_paper_reasons(spark, change, reasons):
    assert validate_papers(paper_frame(spark, change)).first().reasons == reasons


def test_fail_mode_stops_at_an_invalid_paper(spark):
    df = paper_frame(spark, {}, {"paper_id": "bad", "year": 1})
    with pytest.raises(PySparkException, match="invalid paper bad: year out of range"):
        valid_papers(df).collect()


def test_quarantine_splits(spark):
    df = paper_frame(spark, {}, {"paper_id": "bad", "year": 1})
    assert [r.paper_id for r in valid_papers(df, "quarantine").collect()] == ["p"]
    assert [r.paper_id for r in rejected_papers(df).collect()] == ["bad"]
    with pytest.raises(ValueError):
        valid_papers(df, "other")


REQUEST = dict(
    query_id=1, query="optimization", top_k=5, min_year=None, max_year=None, category_contains=None
)


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, []),
        ({"query": " x "}, ["query too short after trim"]),
        ({"query": "x"}, ["query length"]),
        ({"query": None}, ["query missing"]),
        ({"query": "q" * 2001}, ["query length"]),
        ({"query": "  neural information retrieval  ", "top_k": 3}, []),
        ({"min_year": 2018, "max_year": 2024, "category_contains": "cs.AI"}, []),
        ({"min_year": 2020, "max_year": 2010}, ["min_year greater than max_year"]),
        ({"min_year": 1799}, ["min_year out of range"]),
        ({"max_year": 2101}, ["max_year out of range"]),
        ({"top_k": 0}, ["top_k out of range"]),
        ({"top_k": 99}, ["top_k out of range"]),
        ({"top_k": 50}, []),
        ({"category_contains": "   "}, []),
        ({"category_contains": "a%b"}, ["category filter characters"]),
        ({"category_contains": "a\\b"}, ["category filter characters"]),
        ({"category_contains": "cs_AI, x-1. y"}, []),
        ({"category_contains": "c" * 201}, ["category filter too long"]),
        ({"category_contains": "c" * 100_000}, ["category filter too long"]),
    ],
)
def test_request_reasons(spark, change, reasons):
    df = spark.createDataFrame([tuple((REQUEST | change).values())], schema.REQUEST)
    assert validate_requests(df).first().reasons == reasons


def test_requests_are_trimmed_and_defaulted(spark):
    change = {"query": " ab ", "top_k": None, "category_contains": "  "}
    df = spark.createDataFrame([tuple((REQUEST | change).values())], schema.REQUEST)
    row = validate_requests(df).first()
    assert (row.query, row.top_k, row.category_contains) == ("ab", 8, None)


def test_option_bounds():
    assert Options().max_papers is None
    assert Options(max_papers=400).max_papers == 400
    assert Options(max_papers=10**12).max_papers == 10**12
    for bad in ({"max_papers": 0}, {"embedding_dim": 7}, {"embedding_dim": 4097}, {"top_k": 51}):
        with pytest.raises(ValueError):
            Options(**bad)
