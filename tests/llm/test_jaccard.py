import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexivane.llm import jaccard, shingles
from lexivane.llm.components import components, merged
from lexivane.llm.shingles import shingle_sets

from .conftest import frame, odd_texts, words


def shingle_set(text):
    found = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} - {()}


def brute(rows):
    sets, parent = [(i, shingle_set(t)) for i, t in rows if i is not None], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted(((i, len(shingle_set(t)), None if i is None else root(i)) for i, t in rows), key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()), key=str)


def near_copies(seed, groups, members):
    """Chains and stars of edits around the threshold, with a passage that all share."""
    draw, rows, shared = random.Random(seed), [], words(99, 12)
    for g in range(groups):
        base = words(1000 * seed + g, draw.randrange(6, 80))
        for _ in range(members):
            text = list(base)
            for _ in range(draw.randrange(0, 5)):
                text[draw.randrange(len(text))] = f"edit{draw.randrange(10**6)}"
            if draw.random() < 0.4:
                text += shared
            if draw.random() < 0.3:
                base = text
            rows.append((len(rows), " ".join(text)))
    return rows


def test_odd_rows(spark, odd):
    assert found(odd) == brute(odd_texts())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(jaccard, "ANCHOR_LINKS", 2)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 500)
    rows = near_copies(seed, 12, 12)
    assert found(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("outside", [{90: 10}, {90: 10, 91: 12, 92: 8, 93: 30}])
def test_largest_component_is_not_laid_against_itself(spark, outside, monkeypatch):
    """Rows sent grow with the texts outside the largest component; no pair is left out."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 4)
    rows, written = {}, jaccard.staged

    def counting(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counting)
    sizes = {i: 10 + i % 2 for i in range(64)} | outside
    meetings = spark.createDataFrame([(1, i, n) for i, n in sizes.items()], jaccard.MEETINGS)
    labels = spark.createDataFrame([(i, 0) for i in range(64)], "node long, component long")
    bits = spark.createDataFrame([(i, bytes(32)) for i in sizes], "doc_id long, bits binary")
    got = [(r.a, r.b) for r in jaccard.further_pairs(meetings, labels, bits, best=False).collect()]
    near = [(a, b) for a in sizes for b in outside if a < b and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])]
    assert sorted(got) == sorted(near)
    assert rows["jaccard-spread"] <= 64 * len(outside) + len(outside) * (64 // 4 + 3 + len(outside))


def test_an_id_of_two_texts_meets_with_both_sizes():
    keys, ids, sizes = np.array([1, 1, 2, 2], "<u8"), np.array([5, 7, 5, 7], "<i8"), np.array([10, 100, 100, 100], "<i4")
    table = pa.table({"keys": [keys.tobytes()], "docs": [ids.tobytes()], "sizes": [sizes.tobytes()]})
    got = jaccard._meetings(table).to_pylist()
    met = {}
    for row in got:
        met.setdefault(row["meeting"], set()).add((row["doc_id"], row["n"]))
    assert sorted(map(sorted, met.values())) == [[(5, 100), (7, 100)]]


def test_texts_that_are_too_different_in_size_do_not_meet():
    sizes = np.array([10, 12, 16, 20, 24, 100, 124], "<i4")
    keys, ids = np.ones(len(sizes), "<u8"), np.arange(len(sizes), dtype="<i8")
    table = pa.table({"keys": [keys.tobytes()], "docs": [ids.tobytes()], "sizes": [sizes.tobytes()]})
    met = {}
    for row in jaccard._meetings(table).to_pylist():
        met.setdefault(row["meeting"], set()).add(row["doc_id"])
    assert sorted(map(sorted, met.values())) == [[0, 1], [2, 3, 4], [5, 6]]


def laid_out(spark, groups):
    """Meetings, labels and bitmaps of groups of texts of one size, all in one meeting."""
    ids = [(i, g) for g, number in enumerate(groups) for i in range(1000 * g, 1000 * g + number)]
    meetings = spark.createDataFrame([(1, i, 20) for i, _ in ids], jaccard.MEETINGS)
    labels = spark.createDataFrame([(i, 1000 * g) for i, g in ids], "node long, component long")
    return meetings, labels, spark.createDataFrame([(i, bytes(32)) for i, _ in ids], "doc_id long, bits binary")


def test_two_giant_components_hand_on_a_pair_per_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 1024)
    made = laid_out(spark, [400, 300])
    likeliest = jaccard.further_pairs(*made, best=True)
    assert likeliest.count() <= 700 and likeliest.filter("more").count()
    assert jaccard.further_pairs(*made, best=False).count() == 400 * 300


def test_outsiders_hand_on_a_pair_each(spark):
    made = laid_out(spark, [500, *[1] * 60])
    assert jaccard.further_pairs(*made, best=True).count() <= 2 * 60
    assert jaccard.further_pairs(*made, best=False).count() == 500 * 60 + 60 * 59 // 2


def test_a_text_whose_likeliest_partner_is_none(spark, monkeypatch):
    """The pair that the bound likes best does not link, another one does: it is found in a later round."""
    real = jaccard.may_link
    monkeypatch.setattr(jaccard, "ANCHORS", 1)
    monkeypatch.setattr(jaccard, "bitmap", lambda hashes: bytes(32))  # says nothing
    assert real is jaccard.may_link
    rows = near_copies(7, 6, 10)
    assert found(frame(spark, rows)) == brute(rows)


def test_staged_folders_are_removed(spark, odd, monkeypatch):
    import os

    made, written = [], jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: made.append(written(df, name)) or made[-1])
    jaccard.similar_documents(odd).collect()
    left = {f.staged_at.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in made if os.path.isdir(f.staged_at.removeprefix("file:"))}
    assert not left & {"jaccard-counts", "jaccard-entries", "jaccard-spread", "jaccard-open", "jaccard-tiles", "jaccard-need"}


def test_one_of_each(spark, odd):
    left = [r.doc_id for r in jaccard.one_of_each(odd).collect()]
    assert sorted(i for i in left if i) == sorted(i for i, _, c in brute(odd_texts()) if i and i == c)
    assert left.count(None) == 3


def test_empty(nothing):
    assert jaccard.similar_documents(nothing).count() == 0
    assert jaccard.one_of_each(nothing).count() == 0


def test_bound_never_loses_a_link():
    draw = np.random.default_rng(5)
    for _ in range(300):
        common = draw.integers(0, 1 << 63, draw.integers(1, 300), dtype=np.uint64)
        a, b = (np.unique(np.r_[common, draw.integers(0, 1 << 63, draw.integers(0, 60), dtype=np.uint64)]) for _ in "ab")
        maps = [jaccard.bitmap(a), jaccard.bitmap(b)]
        one, other = jaccard.folded(maps, min(map(len, maps)))
        both = len(np.intersect1d(a, b))
        truth = 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard.linked(a, b) == truth
        assert not truth or jaccard.may_link(len(a), len(b), np.bitwise_count(one ^ other).sum())
        cut = set(a[: jaccard.prefix_length(len(a))]) & set(b[: jaccard.prefix_length(len(b))])
        assert not truth or cut


def test_shingles_of_bytes():
    texts = [t for _, t in odd_texts()]
    sets = shingle_sets(pa.array(texts))
    assert all((np.diff(s) > 0).all() for s in sets)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, i) for i in range(201, 260)] + [(3, 2), (3, 2)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {i: 0 for i in range(41)} | {i: 200 for i in range(200, 260)}


def test_components_of_few_and_of_many_nodes_are_equal(spark, monkeypatch):
    draw = random.Random(4)
    links = spark.createDataFrame([(draw.randrange(300), draw.randrange(300)) for _ in range(150)], "a long, b long")
    few = sorted(components(links).collect())
    monkeypatch.setattr("lexivane.llm.components.LABEL_BYTES", 1 << 40)
    assert sorted(components(links).collect()) == few


@pytest.mark.parametrize("group_bytes", [160, 1 << 40])
def test_merged_components_are_those_of_all_links(spark, monkeypatch, group_bytes):
    """Further links join components, add nodes to them, and make new ones; a node may have many of them."""
    monkeypatch.setattr("lexivane.llm.components.GROUP_BYTES", group_bytes)
    monkeypatch.setattr("lexivane.llm.exact.HOT_LEAST", 2)
    draw = random.Random(3)
    first = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    more = [(5, i) for i in range(50, 90, 3)] + [(200, 201), (201, 202), (7, 300)]
    make = lambda links: spark.createDataFrame([(a, b) for a, b in links if a != b], "a long, b long")
    got = merged(components(make(first)), make(more)).collect()
    assert sorted(got) == sorted(components(make(first + more)).collect())


def tables(entries):
    """One row of packed entries: key, id, size, place of the key and the key before it."""
    keys, ids, sizes, places, befores = (np.array(c) for c in zip(*entries, strict=True))
    columns = {"keys": keys.astype("<u8"), "docs": ids.astype("<i8"), "sizes": sizes.astype("<i4")}
    columns |= {"reaches": jaccard.reach(sizes, places).astype("<i4"), "befores": befores.astype("<u8")}
    return pa.table({name: [values.tobytes()] for name, values in columns.items()})


def meeting_ids(table):
    met = {}
    for row in jaccard._meetings(table).to_pylist():
        met.setdefault(row["meeting"], set()).add(row["doc_id"])
    return sorted(map(sorted, met.values()))


def test_texts_whose_common_shingle_comes_too_late_do_not_meet():
    # Of 90 shingles each, 80 must be common: from place 11 on there are not enough.
    assert meeting_ids(tables([(1, 5, 90, 10, 0), (1, 6, 90, 10, 0)])) == [[5, 6]]
    assert meeting_ids(tables([(1, 5, 90, 10, 0), (1, 6, 90, 11, 0)])) == []
    # The smaller of two texts shares more of itself.
    assert meeting_ids(tables([(1, 5, 72, 0, 0), (1, 6, 90, 18, 0), (1, 7, 90, 19, 0)])) == [[5, 6]]


def test_texts_that_share_the_shingle_before_meet_once():
    copies = [(key, i, 100, key - 1, key - 1) for key in range(1, 10) for i in range(50)]
    assert jaccard._meetings(tables(copies)).num_rows == 50
    # An edit of one text: after it, its shingle before is another one.
    edited = [(k, i, n, p, 99 if (k, i) == (5, 0) else b) for k, i, n, p, b in copies]
    assert meeting_ids(tables(edited)) == [list(range(50))]


def test_meetings_miss_no_link_by_brute_force():
    draw = np.random.default_rng(8)
    for _ in range(40):
        base = draw.permutation(400)[: draw.integers(5, 60)]
        sets = [np.unique(np.r_[draw.choice(base, draw.integers(max(1, len(base) - 6), len(base) + 1), replace=False), draw.integers(0, 400, draw.integers(0, 6))]) for _ in range(12)]
        entries = []
        for i, own in enumerate(sets):
            # Shingles of a single text are not handed on.
            held = [(p, k) for p, k in enumerate(own[: jaccard.prefix_length(len(own))]) if sum(k in s for s in sets) > 1]
            entries += [(k + 1, i, len(own), p, held[e - 1][1] + 1 if e else 0) for e, (p, k) in enumerate(held)]
        groups = meeting_ids(tables(entries)) if entries else []
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    assert any(i in g and j in g for g in groups)


def test_a_shingle_of_one_text_is_not_handed_on(spark, monkeypatch):
    rows, written = {}, jaccard.staged

    def keeping(df, name):
        rows[name] = written(df, name)
        return rows[name]

    monkeypatch.setattr(jaccard, "staged", keeping)
    monkeypatch.setattr(jaccard, "discard", lambda *frames: None)
    shared = words(50, 20)
    docs = frame(spark, [(i, " ".join(words(60 + i, 100) + shared * (i < 2))) for i in range(4)])
    jaccard.similar_documents(docs).collect()
    packed = rows["jaccard-entries"].filter("bucket is not null").collect()
    assert sum(len(r["keys"]) // 8 for r in packed) < 2 * (24 + 1)


def test_shingles_of_a_batch_are_made_a_slice_at_a_time(monkeypatch):
    texts = [text for _, text in odd_texts()] * 3
    wanted = [s.tolist() for t in texts for s in shingle_sets(pa.array([t], pa.string()))]
    monkeypatch.setattr(shingles, "TEXT_BYTES", 500, raising=False)
    held = []
    monkeypatch.setattr(shingles, "words_of", lambda few, own=shingles.words_of: held.append((len(few), few.nbytes)) or own(few))
    assert [s.tolist() for s in shingle_sets(pa.array(texts, pa.string()))] == wanted
    assert len(held) > 6 and all(rows == 1 or size < 1000 for rows, size in held)
    assert shingle_sets(pa.array([], pa.string())) == []
