import re

import pytest
from pyspark.sql import functions as F

from lexivane.functions import record as R
from lexivane.functions import text as X


def test_whitespace_is_what_python_strips(spark):
    points = [*range(0, 0xD800), *range(0xE000, 0x11000)]
    rows = [(p, chr(p)) for p in points]
    df = spark.createDataFrame(rows, "p int, c string")
    found = df.filter(F.col("c").rlike(f"^{X.WHITESPACE}$") | (X.strip(F.col("c")) == ""))
    both = df.filter(F.col("c").rlike(f"^{X.WHITESPACE}$") & (X.strip(F.col("c")) == ""))
    expected = {p for p, c in rows if c.isspace()}
    assert {r.p for r in found.collect()} == expected
    assert {r.p for r in both.collect()} == expected
    assert len(expected) == 29


@pytest.mark.parametrize(
    "title",
    ["", None, "  Neural nets  ", "a \u001cb\n\tc ", "　x", "y" * 4100, "a " * 3000],
)
def test_clean_title(one, title):
    plain = re.sub(r"\s+", " ", (title or "").strip())[:4000]
    assert one(X.clean_title(F.col("t")), t=title) == plain


def test_clean_abstract_is_not_cut(one):
    assert one(X.clean_abstract(F.col("t")), t=" a  b " * 2000) == " ".join(["a b"] * 2000)


@pytest.mark.parametrize(
    "title, abstract, expected",
    [
        ("  Title  ", "  Abs\n\npara  ", "Title\n\nAbs\n\npara"),
        ("  ", "text", "text"),
        ("t", " ", "t"),
        (" ", " ", ""),
    ],
)
def test_combined_text(one, title, abstract, expected):
    assert one(X.combined_text(F.col("t"), F.col("a")), t=title, a=abstract) == expected


def test_normalize_text_replaces_bad_bytes(one):
    assert one(X.normalize_text(F.col("b")), b=bytearray(b"hello\xc3\xa9")) == "helloé"
    assert one(X.normalize_text(F.col("b")), b=bytearray(b"a\xffb\xe9")) == "a�b�"
    assert one(X.normalize_text(F.col("b")), b="plain") == "plain"


def test_strip_control_chars(one):
    assert one(X.strip_control_chars(F.col("t")), t="\x01 a\x00b\x7f\n") == "a b"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2301.00001", "2301.00001"),
        (" cs/0101 \n", "cs-0101"),
        ("x" * 70, "x" * 64),
        ("", "unknown"),
        ("  ", "unknown"),
        (None, "unknown"),
    ],
)
def test_paper_id(one, raw, expected):
    assert one(R.paper_id(F.col("i")), i=raw) == expected


@pytest.mark.parametrize(
    "date, expected",
    [("2023-05-01", 2023), ("2023", 2023), ("202", None), ("Mon, 2 Apr", None), (None, None), ("2.02", None)],
)
def test_leading_year(one, date, expected):
    assert one(R.leading_year(F.col("d")), d=date) == expected


@pytest.mark.parametrize(
    "json, expected",
    [
        ('{"update_date": "2023-05-01"}', 2023),
        ('{"update_date": 2023}', None),
        ('{"versions": [{"created": "Mon, 2 Apr 2007 19:18:42 GMT"}]}', None),
        ('{"versions": [{"created": "2007-04-02"}, {"created": "2011"}]}', 2007),
        ('{"versions": ["2019-01-02"]}', 2019),
        ('{"versions": [{"created": 2007}]}', None),
        ('{"versions": []}', None),
        ('{"versions": "2019"}', None),
        ('{"update_date": "soon", "versions": ["2019-01-02"]}', 2019),
        ("{}", None),
    ],
)
def test_record_year(one, json, expected):
    assert one(R.record_year(F.parse_json("j")), j=json) == expected


@pytest.mark.parametrize(
    "categories, kept",
    [("cs.AI cs.LG", True), ("math.CO", False), ("cs.AIX", True), ("CS.AI", False), ("", False), (None, False)],
)
def test_category_listed_is_a_case_sensitive_substring(one, categories, kept):
    codes = ("cs.AI", "cs.LG", "cs.CL")
    assert one(R.category_listed(F.col("c"), codes), c=categories) is kept


def test_optional_fields(one):
    assert one(R.authors(F.col("a")), a="") is None
    assert one(R.authors(F.col("a")), a=" " + "x" * 3000) == " " + "x" * 1999
    assert one(R.stripped_or_null(F.col("d"), 256), d="  ") is None
    assert one(R.stripped_or_null(F.col("d"), 256), d=" 10.1/x ") == "10.1/x"
    assert one(R.category(F.col("c")), c="y" * 600) == "y" * 500
