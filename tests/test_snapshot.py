import json

import pytest
from pyspark.sql import functions as F

from lexivane.options import Options
from lexivane.plans.build import build_corpus
from lexivane.sources import snapshot as S
from lexivane.sources.corpus_files import read_papers, write_papers

GOOD = {
    "id": "hep-ph/9907231",
    "title": " Sparse grids\n for tides ",
    "abstract": " Tides are solved on coarse meshes. " * 3,
    "authors": "M. Oduya and K. Lind",
    "categories": "physics.ao-ph cs.LG",
    "update_date": "2008-11-30",
    "doi": "10.5555/tide.77",
    "journal-ref": "Ocean Lett. 12 (2008) 4",
}


def frame(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value string")


def papers(spark, *records):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return S.papers_from(S.records(frame(spark, *lines))).orderBy("n").collect()


def test_record_becomes_paper(spark):
    (paper,) = papers(spark, GOOD)
    assert (paper.paper_id, paper.title, paper.year) == ("hep-ph-9907231", "Sparse grids for tides", 2008)
    assert paper.abstract == " ".join(["Tides are solved on coarse meshes."] * 3)
    assert (paper.authors, paper.venue, paper.doi) == ("M. Oduya and K. Lind", "Ocean Lett. 12 (2008) 4", "10.5555/tide.77")
    assert paper.category == "physics.ao-ph cs.LG"


def test_other_categories_are_dropped(spark):
    assert papers(spark, GOOD | {"categories": "math.CO"}, GOOD | {"categories": None}) == []


@pytest.mark.parametrize("change", [{"title": None}, {"title": "  "}, {"abstract": ""}])
def test_title_and_abstract_are_required(spark, change):
    assert papers(spark, GOOD | change) == []


def test_absent_and_null_fields(spark):
    record = {k: v for k, v in GOOD.items() if k in ("title", "abstract", "categories")}
    (paper,) = papers(spark, record | {"doi": None, "authors": None})
    assert paper.paper_id == "unknown"
    assert (paper.authors, paper.doi, paper.venue, paper.year) == (None, None, None, None)


def test_repeated_key_takes_the_last(spark):
    line = json.dumps(GOOD)[:-1] + ', "title": "Second"}'
    assert papers(spark, line)[0].title == "Second"


def test_bad_lines_are_told_apart(spark):
    lines = frame(spark, "", "  ", "{bad", "[1]", "null", '"text"', json.dumps(GOOD), "﻿{}")
    faults = {r.n: r.fault for r in S.rejects(lines).collect()}
    assert faults == {2: "bad json", 3: "not an object", 4: "not an object", 5: "not an object", 7: "bad json"}
    assert [r.n for r in S.records(lines).collect()] == [6]


def test_invalid_bytes_are_replaced(spark, tmp_path):
    line = json.dumps(GOOD | {"title": "a@b"}).encode().replace(b"@", b"\xff")
    (tmp_path / "s.json").write_bytes(line + b"\r\n\n" + b"{bad\n")
    lines = S.read_snapshot(spark, str(tmp_path))
    assert S.papers_from(S.records(lines)).first().title == "a�b"
    (reject,) = S.rejects(lines).collect()
    assert reject.file.endswith("s.json") and reject.fault == "bad json"


def test_parse_happens_once(spark):
    rows = S.papers_from(S.records(frame(spark, json.dumps(GOOD))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("parsejson(") == 1


@pytest.fixture
def snapshot(spark, tmp_path):
    """Three files of different size, some lines to be dropped, read in small splits."""
    folder, number = tmp_path / "snapshot", 0
    folder.mkdir()
    for file, size in enumerate((40, 7, 90)):
        lines = []
        for _ in range(size):
            keep = number % 3 != 1
            lines.append(json.dumps(GOOD | {"id": f"p{number}", "categories": "cs.AI" if keep else "x"}))
            number += 1
        (folder / f"f{file}.json").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield str(folder), [f"p{i}" for i in range(number) if i % 3 != 1]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("cap", [1, 30, 55, 1000])
def test_first_rows_are_those_of_the_file_order(spark, snapshot, cap):
    path, expected = snapshot
    lines = S.read_snapshot(spark, path)
    assert lines.rdd.getNumPartitions() > 3
    capped = S.first_rows(S.papers_from(S.records(lines)), cap)
    ordered = [r.paper_id for r in capped.orderBy(*S.POSITION).collect()]
    assert ordered == expected[:cap]


@pytest.mark.parametrize("cap, opened", [(1, 1), (27, 1), (28, 3), (90, 3), (1000, 3)])
def test_first_of_files_opens_no_later_file(spark, snapshot, cap, opened):
    """Files are read in steps of one, two, four, ... until there are enough rows."""
    path, expected = snapshot
    seen = []

    def read(files):
        seen.extend(files)
        return S.papers_from(S.records(S.positioned(spark.read.text(files))))

    files = S.files_in_order(S.read_snapshot(spark, path))
    first = S.first_of_files(files, read, cap)
    assert [r.paper_id for r in first.orderBy(*S.POSITION).collect()] == expected[:cap]
    assert first.columns == [*S.POSITION, *S.PAPER_COLUMNS]
    assert seen == files[:opened] and len(files) == 3


def test_a_later_file_may_be_unreadable(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(GOOD | {"id": f"p{i}"}) for i in range(5)))
    files = [f"file://{folder}/a.json", f"file://{folder}/missing.json"]
    first = S.first_of_files(files, lambda some: S.papers_from(S.records(S.positioned(spark.read.text(some)))), 5)
    assert first.count() == 5


def test_every_outcome_is_counted_by_one_parse(spark, tmp_path):
    good = [json.dumps(GOOD | {"id": i}) for i in ("a", "b", " ")]
    lines = [*good, " ", "{bad", "[1]", "3", json.dumps(GOOD | {"categories": "x"}), json.dumps(GOOD | {"title": " "})]
    rows, seen = S.sorted_out(frame(spark, *lines))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("parsejson(") == 1 and plan.count("Scan") == 1 and "Exchange" not in plan
    papers, bad, counts = S.write_sorted_out(frame(spark, *lines), str(tmp_path / "out"))
    assert counts == {"papers": 3, "bad_json": 1, "not_object": 2, "blank": 1, "unlisted": 1, "no_text": 1, "unknown_ids": 1}
    assert sorted(r.paper_id for r in papers.collect()) == ["a", "b", "unknown"]
    assert sorted((r.value, r.fault) for r in bad.collect()) == [("3", "not an object"), ("[1]", "not an object"), ("{bad", "bad json")]
    want = S.papers_from(S.records(frame(spark, *lines)))
    assert papers.columns == want.columns and sorted(papers.collect(), key=str) == sorted(want.collect(), key=str)


def test_cap_below_one_is_refused(spark, snapshot):
    lines = S.read_snapshot(spark, snapshot[0])
    for cap in (0, -1):
        with pytest.raises(ValueError):
            S.first_rows(lines, cap)


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_build_corpus(spark, snapshot, tmp_path, form):
    path, expected = snapshot
    out = str(tmp_path / "corpus")
    assert build_corpus(spark, path, out, Options(max_papers=20), form=form) == 20
    back = read_papers(spark, out, form)
    assert {r.paper_id for r in back.collect()} == set(expected[:20])


def test_build_of_a_whole_snapshot_reports_and_keeps_rejects(spark, snapshot, tmp_path):
    path, expected = snapshot
    with open(f"{path}/f1.json", "a") as file:
        file.write("{bad\n\n")
    out, reports = str(tmp_path / "corpus"), []
    assert build_corpus(spark, path, out, on_report=reports.append) == len(expected)
    assert {r.paper_id for r in read_papers(spark, out).collect()} == set(expected)
    (report,) = reports
    assert (report["written"], report["papers"], report["bad_json"], report["blank"]) == (len(expected), len(expected), 1, 1)
    (reject,) = spark.read.parquet(f"{out}-rejects").collect()
    assert (reject.value, reject.fault) == ("{bad", "bad json") and reject.file.endswith("f1.json")


def test_existing_output_is_refused_before_reading(spark, tmp_path):
    out = str(tmp_path / "corpus")
    (tmp_path / "corpus").mkdir()
    with pytest.raises(FileExistsError):
        build_corpus(spark, str(tmp_path / "missing"), out)


def test_json_array_and_non_ascii(spark, tmp_path):
    rows = [{"paper_id": "a", "title": "été", "abstract": "x", "year": 2000, "extra": 1}]
    (tmp_path / "papers.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    paper = read_papers(spark, str(tmp_path / "papers.json"), "json-array").first()
    assert (paper.title, paper.year, paper.category) == ("été", 2000, None)


def test_overwrite_replaces(spark, tmp_path):
    out = str(tmp_path / "corpus")
    (paper,) = papers(spark, GOOD)
    df = spark.createDataFrame([paper.asDict()], S.papers_from(S.records(frame(spark, "{}"))).schema)
    assert write_papers(df, out) == 1
    with pytest.raises(FileExistsError):
        write_papers(df, out)
    assert write_papers(df.union(df), out, overwrite=True) == 2
    assert read_papers(spark, out).select(F.count("*")).first()[0] == 2
