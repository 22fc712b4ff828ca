import json

import pytest
from pyspark.sql import functions as F

from lexivane import schema
from lexivane.operators import ann, planning
from lexivane.operators.embed import ModelEmbedder, WordEmbedder, embed
from lexivane.operators.upsert import addressed, last_per_id, merge, winners
from lexivane.options import Options
from lexivane.plans.ingest import build_index, ingest, load_corpus
from lexivane.plans.search import accepted, responses, search
from lexivane.sources import store as store_module
from lexivane.sources.corpus_files import write_papers
from lexivane.sources.generations import read_generations
from lexivane.sources.store import PaperStore
from lexivane.streaming.ingest_stream import read_snapshot_stream, start_ingest
from lexivane.workloads import spark_queries

FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
OPTIONS = Options(embedding_dim=256, buckets=4)


def papers(spark, *rows):
    """Rows of (paper_id, title, authors, year, seq)."""
    full = [(p, t, f"about {t}", a, y, None, None, "cs.AI", s) for p, t, a, y, s in rows]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in schema.PAPER_IN.fields]
    return spark.createDataFrame(full, ", ".join([*fields, "seq int"]))


@pytest.fixture
def store(spark, tmp_path):
    return PaperStore(spark, str(tmp_path / "store"), OPTIONS)


def put(store, df, at=FIRST, **options):
    return ingest(store, df, at, order=["seq"], rebuild_index=False, **options)


def content(store):
    return {r.paper_id: r for r in store.papers().collect()}


def test_upsert_semantics(spark, store):
    report = put(store, papers(spark, *[(f"p{i}", f"title {i}", "A", 2000, i) for i in range(20)]))
    assert (report["rows_in"], report["inserted"], report["updated"]) == (20, 20, 0)
    batch = papers(
        spark,
        ("p3", "early", "B", 2001, 1),
        ("p3", "late", None, None, 2),
        ("new", "fresh", "", 2002, 3),
        ("p4", "changed", "C", 2003, 4),
    )
    report = put(store, batch, SECOND)
    assert (report["rows_in"], report["distinct_ids"]) == (4, 3)
    assert (report["inserted"], report["updated"]) == (1, 2)
    rows = content(store)
    assert len(rows) == 21
    assert (rows["p3"].title, rows["p3"].authors, rows["p3"].year) == ("late", None, None)
    assert rows["p3"].combined_text == "late\n\nabout late"
    assert rows["new"].authors is None
    assert {str(rows[p].created_at)[:10] for p in ("p3", "p4", "p5")} == {"2024-01-01"}
    assert str(rows["new"].created_at)[:10] == "2024-02-01"
    assert rows["p4"].embedding != rows["p5"].embedding


def test_upsert_is_idempotent(spark, store):
    batch = papers(spark, *[(f"p{i % 7}", f"t{i}", None, i, i) for i in range(1990, 2030)])
    put(store, batch)
    before = content(store)
    put(store, batch, SECOND)
    assert content(store) == before


def test_a_version_is_one_folder_and_an_older_one_stays_readable(spark, store):
    put(store, papers(spark, *[(f"p{i}", f"t{i}", "A", 2000, i) for i in range(30)]))
    first = store.pointer()
    batches = [
        [("p1", "b", None, 2000, 1), ("n1", "new", None, 2000, 2)],
        [("p1", "c", None, 2001, 1), ("p2", "d", None, 2000, 2)],
        [("n1", "newer", "X", 2002, 1), ("p1", "e", None, None, 2)],
    ]
    for day, batch in enumerate(batches, 1):
        report = put(store, papers(spark, *batch), f"2024-02-0{day} 00:00:00")
        assert (report["inserted"], report["updated"]) == ((1, 1) if day == 1 else (0, 2))
    state, rows = store.pointer(), content(store)
    assert state.rows == len(rows) == 31 and state.folder != first.folder
    assert {f.split("/bucket=")[0] for f in store.papers().inputFiles()} == {f"file://{store.root}/{state.folder}/papers"}
    assert (rows["p1"].title, rows["p1"].authors, rows["p1"].year) == ("e", None, None)
    assert str(rows["n1"].created_at)[:10] == "2024-02-01"
    assert {r.title for r in store.papers(first).collect()} == {f"t{i}" for i in range(30)}
    # No file is left over from staging, and no table stays registered by a write.
    assert not store._files().listStatus(store._path("staging"))


def test_files_of_a_bucket_do_not_grow_with_versions(spark, store):
    for number in range(4):
        put(store, papers(spark, *[(f"p{i}", f"t{number}", "A", 2000, i) for i in range(number, 30 + number)]))
    files = store.papers().inputFiles()
    assert len(files) <= 2 * OPTIONS.buckets and store.count() == 33


def rows_of_ids(spark):
    return spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("p"), "id")).alias("paper_id"),
        F.col("id").alias("seq"),
        (F.col("id") % 2).cast("double").alias("half"),
        F.col("id").cast("string").alias("title"),
    )


def test_a_hot_id_is_reduced_before_the_shuffle(spark):
    rows = addressed(rows_of_ids(spark))
    chosen = winners(rows, ["seq"])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and plan.count("Exchange") == 1 and "SortAggregate" not in plan
    assert "title" not in plan


def test_the_last_row_of_an_id_is_fetched_by_its_address(spark):
    rows = addressed(rows_of_ids(spark))
    last = last_per_id(rows, ["seq"], copies="copies")
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
    found = {r.paper_id: r for r in last.collect()}
    assert len(found) == 2001 and set(last.columns) == {"paper_id", "half", "title", "copies"}
    assert (found["unknown"].title, found["unknown"].copies) == ("2997", 1000)


def test_an_order_of_several_columns(spark):
    rows = addressed(rows_of_ids(spark))
    last = last_per_id(rows, ["half", "title"])
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
    want = max((float(i % 2), str(i)) for i in range(0, 3000, 3))[1]
    assert {r.seq for r in last.filter("paper_id = 'unknown'").collect()} == {int(want)} and last.count() == 2001


def test_merge_does_not_shuffle_the_corpus(spark, tmp_path):
    path = str(tmp_path / "current")
    spark.range(1000).select(
        F.col("id").cast("string").alias("paper_id"),
        F.lit("t").alias("title"),
        F.lit(FIRST).cast("timestamp").alias("created_at"),
    ).write.parquet(path)
    batch = spark.createDataFrame([("1", "x"), ("z", "y")], "paper_id string, title string")
    kept, new = merge(spark.read.parquet(path), batch, SECOND, 2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert kept.count() == 999 and new.count() == 2


def above_scan(plan, folder):
    """The operators above the scan of a folder, from a plan in lines."""
    lines, path, depth = plan.splitlines(), [], None
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and folder in line)
    for line in reversed(lines[: at + 1]):
        own = len(line) - len(line.lstrip(" :+-"))
        if depth is None or own < depth:
            path.append(line.strip(" :+-"))
            depth = own
    return path[1:]


def test_a_batch_beyond_the_broadcast_bound_does_not_shuffle_the_corpus(spark, store, monkeypatch):
    start = papers(spark, *[(f"p{i}", f"title {i}", "A", 2000, i) for i in range(40)])
    put(store, start)
    monkeypatch.setattr(planning, "BROADCAST_BYTES", planning.KEY_ROW_BYTES)  # one row
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = papers(spark, *[(f"p{i}", f"new {i}", "B", 2001, i) for i in range(30, 50)])
        staged = batch.drop("seq").withColumns({c: F.lit(None).cast(t) for c, t in (("combined_text", "string"), ("embedding", "array<float>"))})
        kept, new = merge(store.bucketed(store.pointer()), staged, SECOND, 20)
        for frame in (kept, new):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "SortMergeJoin" not in plan
            assert not [line for line in above_scan(plan, store.root) if line.startswith("Exchange")]
        report = put(store, batch, SECOND)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = content(store)
    assert (report["inserted"], report["updated"], len(rows)) == (10, 10, 50)
    assert rows["p35"].title == "new 35" and str(rows["p35"].created_at)[:10] == "2024-01-01"


def test_empty_batch_is_an_error(spark, store):
    with pytest.raises(ValueError, match="empty batch"):
        put(store, papers(spark, ("p", "t", None, 2000, 1)).limit(0))
    assert store.count() == 0


def test_papers_without_words_are_counted_and_stored(spark, store):
    df = papers(spark, ("a", "words", None, 2000, 1), ("b", "!!", None, 2000, 2))
    df = df.withColumn("abstract", F.when(F.col("paper_id") == "b", F.lit("??")).otherwise(F.col("abstract")))
    report = put(store, df)
    assert (report["without_vector"], report["inserted"]) == (1, 2)
    assert set(content(store)) == {"a", "b"}
    after = df.filter("paper_id = 'b'").withColumn("paper_id", F.lit("a"))
    assert put(store, after, SECOND)["updated"] == 1
    assert content(store)["a"].abstract == "??"


def test_another_dimension_is_an_error(spark, store):
    other = WordEmbedder(store.options.embedding_dim * 2)
    batch = papers(spark, ("a", "t", None, 2000, 1))
    put(store, batch)
    with pytest.raises(ValueError, match="dimensions"):
        put(store, batch, embedder=other)
    with pytest.raises(ValueError, match="dimensions"):
        search(store, request_frame(spark, (1, "words", 5, None, None, None)), other)
    wrong = batch.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn("combined_text", F.lit("t"))
    with pytest.raises(ValueError, match="numbers"):
        store.upsert(wrong, SECOND, ["seq"])
    assert set(content(store)) == {"a"}


def test_a_missed_target_is_not_tried_with_every_batch(spark, store, corpus_file, monkeypatch):
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    monkeypatch.setattr(ann, "calibrated", lambda *args: None)
    assert not build_index(store) and store.pointer().missed == 300
    version = store.pointer().version
    assert not build_index(store) and store.pointer().version == version
    monkeypatch.undo()
    assert build_index(store, rebuild=True) and store.pointer().missed == 0


def test_an_invalid_paper_stops_the_load_and_changes_nothing(spark, store):
    put(store, papers(spark, ("a", "t", None, 2000, 1)))
    version = store.pointer().version
    bad = papers(spark, ("b", "t", None, 2000, 1), ("c", "t", None, 1, 2))
    with pytest.raises(Exception, match="year out of range"):
        put(store, bad, SECOND)
    assert store.pointer().version == version and set(content(store)) == {"a"}


def test_quarantine_keeps_the_rejects(spark, store, tmp_path):
    bad = papers(spark, ("b", "t", None, 2000, 1), ("c", "t", None, 1, 2))
    put(store, bad, mode="quarantine", rejects_to=str(tmp_path / "rejects"))
    assert set(content(store)) == {"b"}
    (reject,) = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert put(store, bad, mode="quarantine")["rejected"] == 1
    assert (reject.paper_id, reject.reasons) == ("c", ["year out of range"])


def test_create_force_and_count(spark, store):
    assert store.count() == 0 and not store.exists()
    store.create()
    store.create()
    assert store.exists() and store.pointer().version == 0 and store.count() == 0
    put(store, papers(spark, ("a", "t", None, 2000, 1)))
    assert store.count() == 1
    store.create()
    assert store.count() == 1
    store.create(force=True)
    assert store.count() == 0


def test_second_writer_of_a_version_fails(spark, store):
    store.create()
    state = store.pointer()
    store._commit(store._next(state))
    with pytest.raises(RuntimeError, match="another job"):
        store._commit(store._next(state))


def test_a_store_from_before_a_column_and_with_narrow_numbers(spark, store):
    put(store, papers(spark, ("a", "t", None, 2000, 1)))
    state = store.pointer()
    old = store.papers().drop("category").withColumn("year", F.col("year").cast("smallint"))
    folder = f"{store.root}/versions/old/papers"
    old.write.partitionBy("bucket").bucketBy(4, "paper_id").option("path", folder).saveAsTable("old_version")
    spark.sql("DROP TABLE old_version")
    store._commit(store._next(state, folder="versions/old"))
    (row,) = store.papers().collect()
    assert (row.paper_id, row.year, row.category) == ("a", 2000, None)
    put(store, papers(spark, ("b", "t", None, 2001, 1)), SECOND)
    assert {(r.paper_id, r.year, r.category) for r in store.papers().collect()} == {("a", 2000, None), ("b", 2001, "cs.AI")}


def test_generations_of_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.5)], "paper_id string, year tinyint, score float")
    rows.write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("b", 3_000_000_000)], "paper_id string, year bigint").write.parquet(str(tmp_path / "two"))
    wide = spark.createDataFrame([], "paper_id string, year bigint, score double, note string").schema
    found = read_generations(spark, [str(tmp_path / "one"), str(tmp_path / "two")], wide)
    assert found.schema == wide
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1.5, None), ("b", 3_000_000_000, None, None)]
    narrow = spark.createDataFrame([], "paper_id string, year int").schema
    assert read_generations(spark, [str(tmp_path / "one")], narrow).columns == ["paper_id", "year"]
    with pytest.raises(TypeError, match="two: column year is bigint, not int"):
        read_generations(spark, [str(tmp_path / "two")], narrow)


# --- load, index, search ----------------------------------------------------------------


@pytest.fixture
def corpus_file(tmp_path):
    rows = [
        {
            "paper_id": f"p{i}",
            "title": f"topic{i % 10} study{i}",
            "abstract": f"word{i} topic{i % 10} topic{i % 10} shared text",
            "year": 1990 + i % 30,
            "category": f"cs.{'AI' if i % 2 else 'LG'}",
        }
        for i in range(300)
    ]
    path = tmp_path / "papers.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def request_frame(spark, *rows):
    return spark.createDataFrame(list(rows), schema.REQUEST)


def test_load_caps_after_validation_in_file_order(spark, store, corpus_file):
    report = load_corpus(store, corpus_file, FIRST, max_papers=120, skip_index=True)
    assert report["inserted"] == 120 and report["vector_index"] == "skipped"
    assert set(content(store)) == {f"p{i}" for i in range(120)}


@pytest.mark.parametrize("line", ['{"paper_id": "z", "title": "", "abstract": "a"}', '{"paper_id": "z"', '{"paper_id": "z", "title": "t", "abstract": "a", "year": "soon"}'])
def test_an_invalid_paper_beyond_the_cap_stops_the_load_too(spark, store, corpus_file, line):
    with open(corpus_file, "a") as file:
        file.write("\n" + line)
    with pytest.raises(Exception, match="title missing|MALFORMED|Malformed|malformed"):
        load_corpus(store, corpus_file, FIRST, max_papers=10)
    assert store.count() == 0


def test_replace_load_drops_the_rest_and_the_index(spark, store, corpus_file):
    put(store, papers(spark, ("old", "t", None, 2000, 1)))
    assert build_index(store)
    load_corpus(store, corpus_file, SECOND, max_papers=50, replace=True, skip_index=True)
    assert set(content(store)) == {f"p{i}" for i in range(50)}
    assert store.index() is None


def test_index_lifecycle(spark, store, corpus_file):
    assert not build_index(store)
    store.create()
    assert not store.build_index()
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    assert not store.build_index(skip=True)
    small = PaperStore(spark, store.root, Options(embedding_dim=256, buckets=4, index_budget_bytes=100))
    assert not small.build_index()
    assert build_index(store)
    tier, version = store.index(), store.pointer().version
    assert tier.name == "256 planes" and tier.expected >= tier.target
    assert build_index(store) and store.pointer().version == version
    assert store.codes().count() == 300
    assert build_index(store, rebuild=True) and store.pointer().version > version
    store.drop_index()
    assert store.index() is None


def test_index_follows_upserts(spark, store, corpus_file):
    load_corpus(store, corpus_file, FIRST)
    put(store, papers(spark, ("p7", "entirely other", None, 2001, 1), ("q", "new one", None, 2002, 2)), SECOND)
    codes = {r.paper_id: r for r in store.codes().collect()}
    assert len(codes) == 301 and codes["p7"].year == 2001 and "q" in codes
    fresh = ann.code_table(store.papers(), 256, 256, store.index().bands).collect()
    assert {r.paper_id: r for r in fresh} == codes


def test_search_takes_the_index_only_when_asked_and_there(spark, store, corpus_file):
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    request = request_frame(spark, (1, "topic3 study", 5, None, None, None))
    assert {r.approximate for r in search(store, request).collect()} == {False}
    build_index(store)
    assert {r.approximate for r in search(store, request).collect()} == {False}
    through = PaperStore(spark, store.root, Options(embedding_dim=256, use_approximate=True))
    found = search(through, request)
    assert {r.approximate for r in found.collect()} == {True}
    nothing = search(through, request_frame(spark, (1, "topic3", 5, 1800, 1800, None)))
    for results in (found, nothing):
        assert responses(accepted(request), results).first().approximate
    plain = PaperStore(spark, store.root, Options(embedding_dim=256, use_approximate=False))
    assert {r.approximate for r in search(plain, request).collect()} == {False}


def test_search_results_and_responses(spark, store, corpus_file):
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    requests = request_frame(
        spark,
        (1, " topic3 study3 ", 5, None, None, None),
        (2, "topic4", 50, 2000, 2005, "cs_ai"),
        (3, "x", 5, None, None, None),
        (4, "topic5", 5, None, None, "nothing"),
        (5, "???", 5, None, None, None),
    )
    results = search(store, requests)
    rows = results.collect()
    assert {r.query_id for r in rows} == {1, 2}
    first = sorted((r.rank, r) for r in rows if r.query_id == 1)
    assert len(first) == 5 and all("topic3" in r.abstract for _, r in first)
    assert [r.distance for _, r in first] == sorted(r.distance for _, r in first)
    second = [r for r in rows if r.query_id == 2]
    assert second and all(2000 <= r.year <= 2005 and r.category == "cs.AI" for r in second)
    assert all(r.similarity == pytest.approx(1 / (1 + max(r.distance, 0))) for r in rows)
    answers = {r.query_id: r for r in responses(accepted(requests), results).collect()}
    assert set(answers) == {1, 2, 4, 5}
    assert answers[1].query == "topic3 study3" and not answers[1].approximate
    assert [p["rank"] for p in answers[1].results] == [1, 2, 3, 4, 5]
    assert answers[4].results == [] and answers[5].results == []


def test_batch_search_is_the_union_of_single_searches(spark, store, corpus_file):
    load_corpus(store, corpus_file, FIRST)
    rows = [(i, f"topic{i} word{i * 3}", 1 + i, None, None, None) for i in range(6)]
    together = search(store, request_frame(spark, *rows)).collect()
    single = [r for row in rows for r in search(store, request_frame(spark, row)).collect()]
    assert sorted(together, key=str) == sorted(single, key=str)


def test_texts_are_read_from_the_buckets_of_the_hits_only(spark, store, corpus_file):
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    put(store, papers(spark, ("p7", "entirely other", None, 2001, 1)), SECOND)
    results = search(store, request_frame(spark, (1, "topic3", 1, None, None, None)))
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "SortMergeJoin" not in plan


def test_many_hits_do_not_shuffle_the_texts(spark, store, corpus_file, monkeypatch):
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    request = request_frame(spark, *[(i, f"topic{i} study", 5, None, None, None) for i in range(4)])
    few = sorted(search(store, request).collect())
    monkeypatch.setattr(planning, "BROADCAST_BYTES", planning.KEY_ROW_BYTES)
    results = search(store, request)
    plan = results._jdf.queryExecution().executedPlan().toString()
    texts = [i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line]
    assert len(texts) == 1 and "Exchange" not in plan.splitlines()[texts[0] - 1]
    assert sorted(results.collect()) == few


def test_many_files_search_through_a_seed(spark, tmp_path, corpus_file):
    store = PaperStore(spark, str(tmp_path / "many"), Options(embedding_dim=256, buckets=128))
    load_corpus(store, corpus_file, FIRST, skip_index=True)
    few = PaperStore(spark, str(tmp_path / "few"), Options(embedding_dim=256, buckets=4))
    load_corpus(few, corpus_file, FIRST, skip_index=True)
    assert few.sample() is None and 0 < store.sample().count() < 30
    rows = [(i, f"topic{i} word{i * 3} shared", 4, None, None, None) for i in range(6)]
    columns = ["query_id", "rank", "paper_id"]

    def ranked(where):
        return sorted(search(where, request_frame(spark, *rows)).select(columns).collect())

    assert ranked(store) == ranked(few)
    assert build_index(store) and len(ranked(store)) == 24


def test_empty_corpus_is_an_error(spark, store):
    request = request_frame(spark, (1, "topic3", 1, None, None, None))
    with pytest.raises(ValueError, match="empty"):
        search(store, request)
    store.create()
    with pytest.raises(ValueError, match="empty"):
        search(store, request)


# --- stream -------------------------------------------------------------------------------


def line(i, title):
    record = {"id": f"cs/{i}", "title": title, "abstract": f"about {title}", "categories": "cs.AI"}
    return json.dumps(record)


def test_stream_ends_where_the_batches_end(spark, store, tmp_path):
    arriving, checkpoint = tmp_path / "arriving", str(tmp_path / "checkpoint")
    arriving.mkdir()
    (arriving / "a.json").write_text("\n".join([line(1, "one"), line(2, "two"), "{bad", ""]))

    def run(at):
        lines = read_snapshot_stream(spark, str(arriving), max_files=1)
        query = start_ingest(store, lines, checkpoint, written_at=at, embedder=WordEmbedder(256))
        query.awaitTermination()

    run(FIRST)
    assert {p: r.title for p, r in content(store).items()} == {"cs-1": "one", "cs-2": "two"}
    assert build_index(store)
    (arriving / "b.json").write_text("\n".join([line(2, "early"), line(2, "second two"), line(3, "three")]))
    (arriving / "c.json").write_text("{bad\n")
    run(SECOND)
    rows = content(store)
    assert {p: r.title for p, r in rows.items()} == {"cs-1": "one", "cs-2": "second two", "cs-3": "three"}
    assert str(rows["cs-2"].created_at)[:10] == "2024-01-01"
    assert str(rows["cs-3"].created_at)[:10] == "2024-02-01"
    rebuilt = ann.code_table(store.papers(), store.index().bits, 256, store.index().bands)
    assert sorted(store.codes().select(rebuilt.columns).collect()) == sorted(rebuilt.collect())


def test_a_replayed_batch_changes_nothing(spark, store):
    batch = papers(spark, ("a", "t", None, 2000, 1))
    put(store, batch, stream=("s", 0))
    version = store.pointer().version
    assert put(store, batch, SECOND, stream=("s", 0))["skipped"]
    assert store.pointer().version == version
    assert not put(store, batch, SECOND, stream=("s", 1))["skipped"]
    assert not put(store, batch, SECOND, stream=("other", 0))["skipped"]


def test_a_model_is_loaded_once_per_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t)), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] for t in texts]

    texts = spark.range(64).selectExpr("concat('text ', id) AS combined_text").repartition(16)
    embed(texts, ModelEmbedder(load, 8, f"counted {folder}")).write.format("noop").mode("overwrite").save()
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))


def test_streams_keep_and_count_what_they_reject(spark, tmp_path):
    lines = ['{"id": "a/1", "title": "T", "abstract": "words", "categories": "cs.AI", "update_date": "2001"}', "{bad"]
    lines.append('{"id": "a/2", "title": "T", "abstract": "words", "categories": "cs.AI", "update_date": "1000"}')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.txt").write_text("\n".join(lines))
    store, reports = PaperStore(spark, str(tmp_path / "store"), OPTIONS), []
    arriving = read_snapshot_stream(spark, str(tmp_path / "in"))
    start_ingest(store, arriving, str(tmp_path / "progress"), on_report=reports.append).awaitTermination()
    assert [(r["rejected"], r["bad_lines"], r["inserted"]) for r in reports] == [(1, 1, 1)]
    assert (reports[0]["papers"], reports[0]["bad_json"], reports[0]["unlisted"]) == (2, 1, 0)
    assert spark.read.parquet(f"{store.root}/rejects/papers").first().paper_id == "a-2"
    assert spark.read.parquet(f"{store.root}/rejects/lines").first().value == "{bad"


def test_derived_text_is_neither_staged_nor_dealt(spark, store, monkeypatch):
    seen = []
    monkeypatch.setattr(store_module, "merge", lambda *args: seen.append(args[1].columns) or merge(*args))
    put(store, papers(spark, ("a", " one ", "A", 2000, 0), ("b", "two", "B", 2001, 1), ("a", "three", "A", 2002, 2)))
    put(store, papers(spark, ("b", "four", "C", 2003, 0), ("c", "five", "C", 2003, 1)), SECOND)
    assert [c for c in seen if "combined_text" in c] == [] and len(seen) == 2
    texts = {i: r.combined_text for i, r in content(store).items()}
    assert texts == {"a": "three\n\nabout three", "b": "four\n\nabout four", "c": "five\n\nabout five"}
    assert all(".zstd." in f for f in store.papers().inputFiles())


def test_kept_papers_that_break_a_rule_are_stored_and_counted(spark, store, tmp_path):
    bad = papers(spark, ("b", "t", None, 2000, 1), ("c", "t", None, 2398, 2), ("d", "", None, 2000, 3))
    report = put(store, bad, mode="keep")
    assert (report["rows_in"], report["inserted"], report["invalid"], report["rejected"]) == (3, 3, 2, 0)
    assert {i: r.year for i, r in content(store).items()} == {"b": 2000, "c": 2398, "d": 2000}
    path = str(tmp_path / "files")
    assert write_papers(bad.withColumn("paper_id", F.concat(F.lit("x"), "paper_id")), path, compression="gzip") == 3
    report = load_corpus(store, path, SECOND, replace=True, skip_index=True, mode="keep")
    assert (report["rows_in"], report["invalid"]) == (3, 2) and set(content(store)) == {"xb", "xc", "xd"}
    with pytest.raises(ValueError, match="mode"):
        load_corpus(store, path, SECOND, mode="quarantine")


def test_vectors_are_made_as_rows_are_written(spark, store, monkeypatch):
    seen = []
    monkeypatch.setattr(store_module, "merge", lambda *args: seen.append(args[1].columns) or merge(*args))
    put(store, papers(spark, ("a", "one", "A", 2000, 0), ("b", "??", "B", 2001, 1)))
    put(store, papers(spark, ("b", "four", "C", 2003, 0), ("c", "five", "C", 2003, 1)), SECOND)
    assert [c for c in seen if "embedding" in c] == [] and len(seen) == 2
    assert all(r.embedding is not None for r in content(store).values())


def test_an_unfit_vector_leaves_no_version_behind(spark, store):
    put(store, papers(spark, ("a", "t", None, 2000, 1)))
    wrong = papers(spark, ("a", "t", None, 2000, 1)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(ValueError, match="numbers"):
        store.upsert(wrong.withColumn("combined_text", F.lit("t")), SECOND, ["seq"])
    assert len(store._files().listStatus(store._path("versions"))) == 1 and store.pointer().rows == 1


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Papers that break a rule: texts null or blank, and a conversation of 160 turns."""
    folder = tmp_path_factory.mktemp("odd")
    texts = [None, " \n ", "\nno title"] + [f"word{i} and some\nmore words" for i in range(57)]
    documents = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}") for c, n in ((0, 160), (1, 3)) for t in range(n)]
    rows = {
        "documents": (documents, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": ([(i, 1, 0) for i in range(0, 60, 3)], "doc_id bigint, quality int, toxic int"),
        "conversations": (turns, "conv_id bigint, turn bigint, role string, text string"),
        "benchmark": ([(i, f"word{i} and more") for i in range(5)], "item_id bigint, text string"),
    }
    for name, (values, kinds) in rows.items():
        spark.createDataFrame(values, kinds).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_queries_take_whole_tables_whatever_rules_they_break(spark, odd_tables):
    run = lambda name: spark_queries.QUERIES[name](spark, odd_tables).collect()
    (profile,) = run("corpus_profile")
    assert (profile.papers_count, profile.without_vector, profile.vector_index) == (60, 2, "yes")
    (report,) = run("upsert_report")
    assert (report.rows_in, report.distinct_ids, report.inserted, report.updated) == (183, 22, 2, 20)
    loaded = {r.paper_id: r for r in run("replace_load")}
    assert len(loaded) == 60 and (loaded["doc-2"].title, loaded["doc-2"].abstract) == ("", "no title")
    answers = run("search_response")
    assert len(answers) == 10 and all(a.hits for a in answers if a.query_id % 4 in (0, 1, 3))
