"""The registered queries without SQL, column by column, against plain Python over the smallest tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from lexivane.llm import quality, queries

from .conftest import frame, odd_texts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.tables(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_scores(spark, con):
    rows = queries.op1_quality(spark, FOLDER).collect()
    good = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [r.predicted == good[r.doc_id] for r in rows if r.doc_id in good and r.held_out]
    assert len(judged) > 10 and np.mean(judged) > 0.8
    again = {r.doc_id: r.score for r in queries.op1_quality(spark, FOLDER).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_op2_digests(spark, texts):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op2_byte_bpe(spark, FOLDER).collect():
        own = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op3_files(spark, ids):
    start, want = 0, []
    for doc_id, own in ids.items():
        want.append((doc_id, start, len(own), crc(own)))
        start += len(own)
    rows = queries.op3_token_files(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def shingles(text, width):
    found = text.split()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} or {tuple(found)}


def test_op5_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in queries.op5_fingerprints(spark, FOLDER).collect()}
    order, by_text = list(texts), {}
    assert set(rows) == set(texts)
    for place, doc_id in enumerate(reversed(order)):
        text, following = texts[doc_id], texts[order[len(order) - 2 - place]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(text.lower(), 5), shingles(following.lower(), 5)
        if len(a) > 50 and len(b) > 50:
            assert abs(r.near_next - len(a & b) / len(a | b)) < 0.2


def test_op7_places(spark, ids):
    rows = queries.op7_best_two_fit(spark, FOLDER).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == crc(ids[doc_id][at : at + r.length])
            at += r.length
        assert at == len(ids[doc_id]) and all(r.length == 1024 for r in own[1:])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 1024)


ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def test_op8_spans(spark, texts):
    for r in queries.op8_secret_scan(spark, FOLDER).collect():
        text, found = texts[r.doc_id], []
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        order = ["assign", "access", "hex"]
        found.sort(key=lambda s: (s[1], order.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in found) for kind in order]
        assert set(listed.split(",")) <= set(r.spans.split(","))


# --- unlabelled, empty and odd tables ---------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows, score", [([], 1.0), ([(7, 0, 0), (8, 0, 0)], 0.0), ([(7, 1, 0), (8, None, 0), (10, 5, 0)], 1.0)])
def test_nothing_to_learn(spark, odd, rows, score):
    model = quality.fit(odd, labels(spark, rows))
    assert {r.score for r in quality.score(odd, model).collect()} == {score}
    assert quality.keep_good(odd, model).count() == (len(odd_texts()) if score >= 0.7 else 0)


def stage_folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_queries_on_empty_tables(spark, nothing, tmp_path):
    folder = stage_folder(spark, tmp_path, nothing)
    assert queries.op1_quality(spark, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Without labels nothing is rejected; copies and near copies go, all else is packed whole."""
    folder = stage_folder(spark, tmp_path, odd)
    packed = corpus_pipeline.run(spark, folder).collect()
    left = {r.doc_id for r in packed}
    assert left >= {10, 12, 13, 14} and None in left
    # Of the empty texts and of the equal ones the largest id stays, of similar ones the smallest.
    assert not left & {1, 5} and left >= {2, 3, 6}
