import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.operators import ann
from lexivane.operators.search import batch_nearest, query_blocks
from lexivane.options import Options

DIM, BITS = 16, 64
TIER = ann.Tier("t", BITS, 0.9)
COLUMNS = ["query_id", "rank", "paper_id"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, DIM))
    rows = []
    for i in range(600):
        vector = (centres[i % 12] + rng.normal(size=DIM) * 0.5).astype(np.float32).tolist()
        vector = None if i == 5 else [0.0] * DIM if i == 6 else vector
        rows.append((f"p{i}", vector, 1990 + i % 30, f"c{i % 4}"))
    kinds = "paper_id string, embedding array<float>, year int, category string"
    return rows, spark.createDataFrame(rows, kinds).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "codes")
    ann.write_index(ann.code_table(corpus[1], BITS, DIM), path)
    return spark.read.parquet(path)


def queries_of(spark, rows, **filters):
    picked = [(i, rows[i * 7 + 20][1], 8) for i in range(20)]
    df = spark.createDataFrame(picked, "query_id long, embedding array<float>, top_k int")
    return df.withColumns({k: F.lit(v) for k, v in filters.items()})


def ranked(frame):
    return sorted(frame.select(COLUMNS).collect())


def test_codes_are_the_sides_of_md5_planes(spark, corpus):
    rows, df = corpus
    codes = {r.paper_id: r for r in ann.code_table(df, BITS, DIM).collect()}
    assert set(codes) == {r[0] for r in rows} - {"p5", "p6"}
    for pid, vector, *_ in rows[:5]:
        words = [0] * (BITS // 32)
        for j in range(BITS):
            signs = [
                1 - 2 * (int(hashlib.md5(f"{j}:{i}".encode()).hexdigest()[0], 16) % 2) for i in range(DIM)
            ]
            if sum(s * x for s, x in zip(signs, vector, strict=True)) > 0:
                words[j // 32] |= 1 << (j % 32)
        assert codes[pid].code == words and codes[pid].band == words[0] % 64


def test_reach_of_codes_is_that_of_a_binomial():
    def within(t, chance):
        return sum(math.comb(BITS, n) * chance**n * (1 - chance) ** (BITS - n) for n in range(t + 1))

    reach = ann.reaches(BITS, 0.95)
    assert list(reach) == sorted(reach) and len(reach) == BITS
    for t in (0, 3, 20, 60):
        chance = math.acos(1 - reach[t]) / math.pi
        assert within(t, chance) == pytest.approx(0.95, abs=1e-5)
    limits = ann.bits_within(np.array([0.0, reach[7], reach[7] + 1e-6, 2.0]), BITS, 0.95)
    assert limits.tolist() == [0, 7, 8, BITS]


def test_near_bands_hold_their_share_of_near_rows():
    """Random rows at a known angle lie in the bands as often as asked for, and a nearer
    bound needs fewer bands."""
    rng = np.random.default_rng(0)
    dim, bands = 64, 6
    query = rng.normal(size=(1, dim))
    unit = query[0] / np.linalg.norm(query)
    numbers = []
    for distance in (0.02, 0.2, 0.6):
        near = ann.near_bands(query, np.array([distance]), bands, 0.95)[0]
        side = rng.normal(size=(4000, dim))
        side -= (side @ unit)[:, None] * unit
        side /= np.linalg.norm(side, axis=1)[:, None]
        rows = (1 - distance) * unit + math.sqrt(1 - (1 - distance) ** 2) * side
        above = rows @ ann.kernels.planes(32, dim)[:bands].T.astype(float) > 0
        band = (above << np.arange(bands)).sum(axis=1)
        assert near[band].mean() > 0.93
        numbers.append(near.sum())
    assert numbers == sorted(numbers) and numbers[0] < 16 < numbers[2] <= 64


def test_bands_open_by_distance_to_their_planes():
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(3, DIM))
    places = ann.band_places(matrix, 6)
    far, above = ann.margins(matrix, 6)
    for q in range(3):
        own = sum(1 << j for j in range(6) if above[q, j])
        nearest = min(range(6), key=lambda j: far[q, j])
        assert places[q, own] == 0 and places[q, own ^ 1 << nearest] == 1
        assert sorted(places[q]) == list(range(64))


def test_a_search_finds_its_share(spark, corpus, index):
    rows, df = corpus
    queries = queries_of(spark, rows)
    exact = set(ranked(batch_nearest(df, queries, Options())))
    found = set(ranked(ann.approximate_nearest(index, queries, replace(TIER, expected=0.99), Options())))
    assert len({(r.query_id, r.paper_id) for r in exact & found}) >= 0.95 * len(exact)


def test_a_share_of_all_is_an_exact_search(spark, corpus, index):
    rows, df = corpus
    queries = queries_of(spark, rows, min_year=1995, category_contains="c_")
    sure = replace(TIER, expected=1.0 - 1e-12)
    assert ranked(ann.approximate_nearest(index, queries, sure, Options())) == ranked(batch_nearest(df, queries, Options()))


def test_queries_with_few_rows_open_all_bands(spark, corpus, index):
    """Few rows pass the filter; all of them are found, by whatever share."""
    rows, df = corpus
    queries = queries_of(spark, rows, min_year=2019, max_year=2019, category_contains="C1")
    allowed = {r[0] for r in rows if r[2] == 2019 and r[3] == "c1"}
    hits = ann.approximate_nearest(index, queries, replace(TIER, expected=0.01), Options()).collect()
    assert {h.paper_id for h in hits} <= allowed
    assert len(hits) == 20 * min(8, len(allowed))


def test_only_opened_bands_are_read(spark, corpus, index):
    rows, _ = corpus
    queries = queries_of(spark, rows).limit(1)
    (block,) = query_blocks(queries, Options())
    opened = ann.band_places(block["matrix"], TIER.bands) < 3
    hits = ann.screened(index, block, opened, "bigint", bits=BITS).frame
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [band" in plan
    bands = set(np.flatnonzero(opened[0]).tolist())
    table = {r.paper_id: r.band for r in index.collect()}
    assert len(bands) == 3 and {table[h.paper_id] for h in hits.collect()} <= bands
    files = index.filter(F.col("band").isin(sorted(bands))).select(F.input_file_name()).distinct().count()
    assert files <= 3 < len(index.inputFiles())


def test_a_near_query_reads_few_bands_and_measures_few_rows(spark, corpus, index, monkeypatch):
    rows, _ = corpus
    seen = []
    real = ann.screened
    monkeypatch.setattr(ann, "screened", lambda *args, **more: seen.append(args[2:]) or real(*args, **more))
    query = spark.createDataFrame([(1, rows[20][1], 1)], "query_id long, embedding array<float>, top_k int")
    assert ann.approximate_nearest(index, query, TIER, Options()).first().paper_id == "p20"
    opened, kind, near, bound, _ = seen[-1]
    assert (opened | near).sum() < 16 and bound[0] <= 2


def test_recall_and_calibration(spark, corpus, index):
    rows, _ = corpus
    queries = queries_of(spark, rows)
    measured = {r.expected: r for r in ann.recall_by_share(index, queries, TIER, Options(), (0.5, 0.999)).collect()}
    assert measured[0.5].recall <= measured[0.999].recall <= 1.0 and measured[0.5].neighbours == 160
    assert measured[0.999].recall > 0.95
    assert ann.calibrated(index, queries, TIER, Options()).expected >= 0.9
    assert ann.calibrated(index, queries, replace(TIER, target=None), Options()).expected is None
    assert ann.calibrated(index, queries.limit(0), TIER, Options()).expected == 0.9


def test_a_missed_target_means_no_index(spark, corpus, index, monkeypatch):
    recall = spark.createDataFrame([(0.5,)], "recall double")
    monkeypatch.setattr(ann, "recall_by_share", lambda *args: recall)
    assert ann.calibrated(index, queries_of(spark, corpus[0]), TIER, Options()) is None


def test_tier_choice_by_budget(spark):
    assert ann.choose_tier(100, 3200).name == "256 planes"
    assert ann.choose_tier(100, 3199).name == "128 planes"
    assert ann.choose_tier(100, 800).name == "64 planes"
    assert ann.choose_tier(100, 400).name == "32 planes"
    assert ann.choose_tier(100, 399) is None
    assert [t.target for t in ann.TIERS] == [0.95, 0.90, None, None]
    budgets = [3200, 3199, 800, 400, 399]
    df = spark.createDataFrame([(100, b) for b in budgets], "n bigint, b bigint")
    bits = [r[0] for r in df.orderBy(F.desc("b")).select(ann.tier_bits(F.col("n"), F.col("b"))).collect()]
    assert bits == [256, 128, 64, 32, None]


def test_bands_grow_with_the_corpus():
    assert [ann.TIERS[0].for_rows(n).bands for n in (10, 1 << 22, (1 << 22) + 1, 1 << 24, 1 << 40)] == [6, 6, 6, 8, 12]


def test_blocks_give_the_same(spark, corpus, index):
    rows, _ = corpus
    queries = queries_of(spark, rows)
    whole = ann.approximate_nearest(index, queries, TIER, Options()).collect()
    parts = ann.approximate_nearest(index, queries, TIER, Options(query_block_rows=7)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_vectors_are_not_shuffled(spark, corpus, index):
    hits = ann.approximate_nearest(index, queries_of(spark, corpus[0]), TIER, Options())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "embedding" in line]


def test_a_paper_is_no_neighbour_of_itself(spark, corpus, index):
    queries = ann.sample_papers(corpus[1], "embedding")
    with_self, without = (
        ann.recall_by_share(index, queries, TIER, Options(), (0.5,), own).first() for own in (False, True)
    )
    assert without.neighbours < with_self.neighbours and without.recall <= with_self.recall
