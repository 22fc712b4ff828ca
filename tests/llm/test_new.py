"""SimHash links, Merkle proofs and vector codes against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import compare
from lexivane.llm import merkle, queries, simhash, veccode
from lexivane.llm.shinglehash import shingle_spans, words_of, xxh64_spans

from .conftest import odd_texts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.tables(FOLDER)


# --- simhash -----------------------------------------------------------------------


def brute_print(text, width=4):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, distance=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, doc_id in zip(label, ids, strict=True):
        least[x] = min((v for v in (least.get(x), doc_id) if v is not None), default=None)
    return [least[x] for x in label]


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    found = brute_components(prints, [i for i, _ in rows])
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, found, strict=True)), key=str)


def got_simhash(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_hashes_are_xxh64():
    draw = random.Random(3)
    raw = [bytes(draw.choices(b"ab Cz\t\xc3\xa9", k=draw.randrange(300))) for _ in range(200)]
    raw += [None, b"", b" \n", b"x" * 200, b"a " * 5]
    spans = words_of(pa.array(raw, pa.binary()))
    start, length, counts = shingle_spans(spans, 4)
    got = iter(xxh64_spans(spans.buffer, start, length, 42).tolist())
    for text, number in zip(raw, counts.tolist(), strict=True):
        found = (text or b"").lower().split()
        want = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
        assert [next(got) for _ in range(number)] == [xxhash.xxh64_intdigest(s, 42) for s in want]


def test_sliced_and_null_batches():
    texts = pa.array(["a b", None, "c d e", "f"]).slice(1, 2)
    spans = words_of(texts)
    assert spans.counts.tolist() == [0, 3] and bytes(spans.buffer[:6]) == b"c d e "


def test_majority_of_more_hashes_than_a_byte_counts():
    draw = np.random.default_rng(5)
    counts = np.array([0, 1, 254, 255, 256, 0, 1000, 2])
    hashes = draw.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    want, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n].tolist()
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n))
        at += n
    assert simhash.majority(hashes, counts).tolist() == want


def test_simhash_odd_rows(spark, odd):
    assert got_simhash(simhash.similar_documents(odd)) == brute_simhash(odd_texts())


def test_simhash_empty(nothing):
    assert simhash.similar_documents(nothing).collect() == []


def flipped(value, number, draw):
    for bit in draw.sample(range(64), number):
        value ^= 1 << bit
    return value


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("most", [1024, 4])
def test_no_link_is_lost(spark, most):
    """Near prints at every number of differing bits, dense balls, and many prints of one segment."""
    draw = random.Random(most)
    prints = {draw.getrandbits(64) for _ in range(100)}
    for value in list(prints)[:60]:
        prints |= {flipped(value, n, draw) for n in (1, 3, 4, 5)}
    centre = draw.getrandbits(64)
    prints |= {flipped(centre, draw.randrange(1, 5), draw) for _ in range(80)}
    prints |= {(centre & ~((1 << 42) - 1)) | draw.getrandbits(42) for _ in range(60)}
    prints = sorted(prints)
    classes = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    settings = simhash.Settings(most=most)
    label = list(range(len(prints)))
    at = {signed(p): i for i, p in enumerate(prints)}
    for row in simhash.links(classes, settings).collect():
        one, other = label[at[row.a]], label[at[row.b]]
        label = [one if x == other else x for x in label]
    want = brute_components(prints, range(len(prints)))
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    assert sorted(groups.values()) == sorted([i for i, y in enumerate(want) if y == x] for x in set(want))


def test_dense_ball_hands_on_few_rows():
    draw = random.Random(1)
    centre = draw.getrandbits(64)
    prints = np.array(sorted({flipped(centre, 2, draw) for _ in range(800)}), np.uint64)
    key, bit = np.zeros(len(prints), np.int64), np.full(len(prints), -1, np.int8)
    a, b = simhash.linked_pairs(key, bit, prints, 4)
    assert len(simhash.joined(prints[a], prints[b])[0]) == len(prints) - 1 < len(a)


def test_simhash_query(spark, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert got_simhash(queries.op11_simhash(spark, FOLDER)) == brute_simhash(rows)


# --- merkle ------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes):
    """Root and, per node, the siblings left and right of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_at, place in enumerate(at):
            run = place // 3 * 3
            paths[leaf_at].append((nodes[run:place], nodes[place + 1 : run + 3]))
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def brute_merkle(rows):
    """Rows are doc_id, source, lang, n_chars, text."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[source] = (own, *brute_tree([brute_leaf(r) for r in own]))
    root, tops = brute_tree([trees[s][1] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[source]
        for row, path in zip(own, paths, strict=True):
            reached = brute_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                reached = brute_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in path + top:
                reached = digest(*left, reached, *right)
            proof = digest(*[d for left, right in path + top for d in left + right])
            out.append((row[0], brute_leaf(row), subroot, root, proof, reached, reached == root))
    return sorted(out, key=str)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got_merkle(df):
    assert df.columns[:7] == MERKLE
    return sorted((tuple(r[c] for c in MERKLE) for r in df.collect()), key=str)


def checked(docs, **more):
    odd_ids = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(docs, {"text": F.translate("text", "\n", "")}, odd_ids, **more)


def test_merkle_sizes_around_blocks(spark):
    """Sources of one to many rows, with blocks so small that several rounds are taken."""
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 31]
    rows, number = [], 0
    for source, size in enumerate(sizes):
        for _ in range(size):
            rows.append((number * 7 % 1000, f"s{source}", "en", number, f"text\n{number}"))
            number += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got_merkle(checked(docs, block_levels=1)) == brute_merkle(rows)


def test_merkle_odd_rows(spark, odd):
    rows = [(i, "src0", "en", None if t is None else len(t), t) for i, t in odd_texts()]
    rows += [(5, None, None, None, None), (5, None, None, None, None), (6, "É", "", 0, ""), (None, "", "x", 1, "a\nb"), (6, "src0", "x", 2, "\n")]
    extra = spark.createDataFrame(rows[-5:], "doc_id long, source string, lang string, n_chars long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    assert got_merkle(checked(docs)) == brute_merkle(rows)


def test_merkle_empty_and_single(spark, nothing):
    assert checked(nothing).collect() == []
    one = spark.createDataFrame([(2, "s", "en", 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(one, keep_proof=True).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == [] and row.verified


def test_queue_holds_open_runs_only():
    digests = [digest(str(i)) for i in range(3**merkle.BLOCK_LEVELS)]
    top, nodes = merkle.forward(digests, merkle.BLOCK_LEVELS)
    root, paths = brute_tree(digests)
    assert top == root and [label for label, _ in nodes] == sorted(label for label, _ in nodes)
    swept = list(merkle.backward(digests, merkle.BLOCK_LEVELS, ()))[::-1]
    assert [merkle.folded(d, s) for d, s in zip(digests, swept, strict=True)] == [root] * len(digests)
    assert [["".join(left), "".join(right)] for left, right in paths[100]] == [[p["left"], p["right"]] for p in merkle.listed(swept[100])]


def test_merkle_query(spark, con):
    rows = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    got = got_merkle(queries.op12_merkle(spark, FOLDER))
    assert got == brute_merkle(rows)
    assert {r[-1] for r in got} == {True, False}


# --- vector codes --------------------------------------------------------------------


def brute_codes(rows, entries=16, rounds=6, parts=8):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(4096 * x) for x in vector], label))
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    each = width // parts
    books, codes = [], []
    for part in range(parts):
        own = [r[1][part * each : (part + 1) * each] for r in kept]
        book = [list(v) for v in own[:entries]]

        def nearest(v, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            near = [nearest(v)[1] for v in own]
            for entry in set(near):
                held = [v for v, e in zip(own, near, strict=True) if e == entry]
                book[entry] = [sum(column) // len(held) for column in zip(*held, strict=True)]
        books.append(book)
        codes.append([nearest(v) for v in own])
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(flat.encode()).hexdigest()
    errors = [sum(c[i][0] for c in codes) for i in range(len(kept))]
    by_label = {}
    for row, error in zip(kept, errors, strict=True):
        by_label[row[2]] = by_label.get(row[2], 0) + error
    spelled = ["".join(f"{c[i][1]:02x}" for c in codes) for i in range(len(kept))]
    rows = zip(kept, spelled, errors, strict=True)
    return sorted(((r[0], code, error, by_label[r[2]], sha) for r, code, error in rows), key=str)


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def got_codes(df):
    assert df.columns[:5] == CODES
    return sorted((tuple(r[c] for c in CODES) for r in df.collect()), key=str)


def vectors(spark, rows, parts=4):
    clashing = [(*r, 1, 2, "x") for r in rows]
    schema = "vec_id long, embedding array<float>, label int, numbers int, n long, code string"
    return spark.createDataFrame(clashing, schema).repartition(parts)


def drawn(number, width, seed, grid=None):
    draw = random.Random(seed)
    return [
        (i * 3 % number, [float(np.float32(draw.randrange(-3, 4) / 4 if grid else draw.gauss(0, 0.3))) for _ in range(width)], i % 4 or None)
        for i in range(number)
    ]


@pytest.mark.parametrize("grid", [None, True])
def test_codes_equal_brute_force(spark, grid):
    rows = drawn(400, 16, 1, grid)  # on the grid there are many ties and copies
    assert got_codes(veccode.vector_codes(vectors(spark, rows))) == brute_codes(rows)


def test_codes_odd_rows(spark):
    good = drawn(30, 16, 2)
    odd = [
        (100, None, 1),
        (101, [None] + [0.0] * 15, 1),
        (102, [float("nan")] + [0.0] * 15, None),
        (103, [float("-inf")] + [0.0] * 15, 2),
        (104, [0.0] * 8, 2),
        (105, [], 2),
        (5, good[0][1], 7),
        (5, good[0][1], 7),
        (None, [1.0] * 16, None),
    ]
    assert got_codes(veccode.vector_codes(vectors(spark, good + odd))) == brute_codes(good + [r for r in odd if r[0] not in (104, 105)])


def test_codes_of_large_numbers_are_bounded(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, 2)]
    got = got_codes(veccode.vector_codes(vectors(spark, rows)))
    assert [r[2] for r in got] == [0, 0, 0]


@pytest.mark.parametrize("number", [0, 1, 5])
def test_codes_of_few_vectors(spark, number):
    rows = drawn(number, 16, 3)
    assert got_codes(veccode.vector_codes(vectors(spark, rows, 1))) == brute_codes(rows)


def test_length_that_cannot_be_cut(spark):
    assert got_codes(veccode.vector_codes(vectors(spark, drawn(20, 12, 4)))) == []


def test_bounds_spare_measurements():
    draw = np.random.default_rng(0)
    rows = draw.integers(-2000, 2000, (3000, 8)) + 20_000 * draw.integers(0, 16, (3000, 1))
    book = rows[:16].copy()
    entry, squared, measured = veccode.nearest_entries(rows, veccode.lengths(rows, book[:4]), book[:4], book)
    exact = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == exact.argmin(axis=1)).all() and (squared == exact.min(axis=1)).all()
    assert measured < exact.size / 2


def test_codes_query(spark, con):
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert got_codes(queries.op13_vector_codes(spark, FOLDER)) == brute_codes(rows)
