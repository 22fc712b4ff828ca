import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from math import ceil

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexivane.llm import bpe, packing, pieces, rollup, tokenfile
from lexivane.llm.pieces import PieceEncoder
from lexivane.session import work_dir

from .conftest import frame, odd_texts

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "b c", " ", "  ", "\n", "'s", "don't", "12", "é", "日本", "!", " ", "​", "\x1c", "xxxxx", "<|endoftext|>"]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def drawn(seed, number):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(40))) for _ in range(number)]


def test_pieces_equal_whole_texts(whole):
    encoder = PieceEncoder(PATH, cache_bytes=20_000)
    texts = drawn(1, 600) + [t or "" for _, t in odd_texts()]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encoder.encode(texts[at : at + 50]), strict=True):
            assert ids.tolist() == whole(text), text


def test_cut_texts_have_the_same_ids():
    codec = bpe.rank_codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    draw = random.Random(2)
    for text in drawn(3, 800):
        assert "".join(bpe.cuts(text, codec.pattern, 5)) == text
        assert codec.encode(text, draw.randrange(1, 12)).tolist() == codec.encoding.encode_ordinary(text), text
    for text in ("a" * 200_000, " " * 200_000 + "b", "日" * 100_000, "\n " * 70_000):
        assert codec.decode(codec.encode(text)).decode() == text


def test_bpe_of_odd_rows(odd, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.rank_codec(path, P.PATTERN)
    rows = bpe.encode_decode(odd, path, P.PATTERN).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = Counter()
    for doc_id, text in odd_texts():
        ids = codec.encoding.encode_ordinary(text or "")
        want[(doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode())] += 1
    assert got == want
    digests = bpe.encode_decode(odd, path, P.PATTERN, digests=True).collect()
    assert {bytes(r.ids) for r in digests} == {hashlib.sha256(k[2]).digest() for k in want}
    assert bpe.encode_decode(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    draw = np.random.default_rng(bits)
    for number in (0, 1, 63, 64, 65, 1000):
        ids = draw.integers(0, 1 << bits, number, dtype=np.uint64).astype(np.uint32)
        raw = tokenfile.pack_bits(ids, bits)
        assert len(raw) == ceil(number / 64) * 8 * bits
        assert tokenfile.unpack_bits(raw, bits, number).tolist() == ids.tolist()


def test_token_files(spark, odd, nothing, whole, monkeypatch):
    manifest = tokenfile.write_token_files(odd, PATH, 2, work_dir(spark, "tokens"))
    rows = sorted(tokenfile.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_texts()), key=lambda i: -1 if i is None else i)
    by_id, start = {}, 0
    for doc_id, text in odd_texts():
        ids = np.array([*whole(text), 2], "<u4")
        by_id.setdefault(doc_id, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for row in rows:
        assert row.start == start and (row.n_tokens, row.ids_crc32) in by_id[row.doc_id]
        start += row.n_tokens
    reader = tokenfile.TokenReader(max(manifest.collect(), key=lambda r: r.tokens).path)
    everything = reader.ids(0, reader.tokens)
    for number in range(len(reader.doc_ids)):
        a, b = reader.offsets[number : number + 2]
        assert reader.document(number).tolist() == everything[a:b].tolist()
    empty = tokenfile.write_token_files(nothing, PATH, 2, work_dir(spark, "tokens"))
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_fills_use_every_length_once():
    draw = random.Random(4)
    for _ in range(60):
        capacity = draw.choice([10, 64, 1024])
        counts = {draw.randrange(1, capacity + 1): draw.randrange(1, 500) for _ in range(draw.randrange(1, 60))}
        used, number = Counter(), 0
        for fill in packing.plan_fills(counts, capacity):
            assert sum(fill.lengths) <= capacity
            number += fill.times
            for length in fill.lengths:
                used[length] += fill.times
        assert used == Counter(counts)
        least = ceil(sum(k * v for k, v in counts.items()) / capacity)
        assert number <= max(least + 1, 1.23 * max(least, sum(v for k, v in counts.items() if 2 * k > capacity)) + 1)


def test_two_replace_the_smallest():
    """Greedy fills 6+3 of 10; 2+2 fit the gap of 4 tighter than 3."""
    fills = packing.plan_fills({6: 1, 3: 1, 2: 2}, 10)
    assert fills[0].lengths == (6, 2, 2)


def test_packing_of_odd_rows(odd, nothing, whole):
    rows = packing.pack(odd, PATH, 2, 64).collect()
    per_sequence, per_doc = {}, Counter()
    for r in rows:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for doc_id, text in odd_texts():
        ids = np.array([*whole(text), 2], "<u4")
        first = len(ids) % 64 or 64
        for piece, start in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[start : first if not start else start + 64]
            want[(doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert per_doc == want
    assert packing.pack(nothing, PATH, 2).count() == 0


def test_rollup(spark, odd, nothing, whole):
    counts = rollup.bpe_counts(odd, PATH, "bpe").unionByName(rollup.word_counts(odd, "words"))
    totals = rollup.CountRollup(spark, work_dir(spark, "rollup"))
    assert totals.totals().count() == 0
    assert totals.commit("load", rollup.changes(counts, "insert"))
    tokens = sum(len(whole(t)) for _, t in odd_texts())

    def now():
        return {r.tokenizer: (r.docs, r.tokens) for r in totals.totals().collect()}

    assert now() == {"bpe": (18, tokens), "words": (18, sum(len((t or "").split()) for _, t in odd_texts()) - 2)}
    small = rollup.changes(counts.filter("doc_id = 5 and tokenizer = 'bpe'").withColumn("tokens", counts.tokens + 3), "revise", "tokens - 3")
    assert totals.commit("revise", small) and not totals.commit("revise", small)
    totals.fold()
    gone = rollup.changes(counts.filter("doc_id = 4 and tokenizer = 'bpe'"), "delete")
    assert totals.commit("gone", gone) and not totals.commit("gone", gone) and not totals.commit("load", gone)
    assert now()["bpe"] == (16, tokens + 3 - 2 * len(whole("one")))
    totals.fold()
    assert now()["bpe"] == (16, tokens + 3 - 2 * len(whole("one")))
    assert totals.commit("none", rollup.changes(rollup.word_counts(nothing, "words"), "insert"))
    with pytest.raises(Exception, match="unknown kind"):
        totals.commit("wrong", rollup.changes(counts, "other"))
    assert "wrong" not in totals.committed()


def test_words_are_merged_once_whatever_marks_follow(whole, monkeypatch):
    """A Latin word with ASCII marks behind it needs no splitting rules, and its ids are made once."""
    encoder = PieceEncoder(PATH)
    joined = []
    monkeypatch.setattr(encoder, "_joined", lambda pieces, own=encoder._joined: joined.extend(pieces) or own(pieces))
    marks = ["", ".", "%%%", "'", "''", "*&*", '."', "_", "`~", "<|>", "{}", "^^", "\\", "@/"]
    words = ["été", "Word", "a", "naïve", "l"]
    texts = [" ".join(w + m for m in marks for w in words), *(f"{w}{m} {w}{m}" for m in marks for w in words)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == whole(text), text
    assert joined == []
    later = ["x Word%% Word&", "Word Word%% été''s été'"]  # the second word was met alone
    assert [i.tolist() for i in encoder.encode(later)] == [whole(t) for t in later]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_a_batch_is_encoded_a_slice_at_a_time(whole, monkeypatch, kind):
    monkeypatch.setattr(pieces, "TEXT_BYTES", 300, raising=False)
    encoder = PieceEncoder(PATH)
    met = []
    monkeypatch.setattr(encoder, "_learn", lambda kept, new, before, own=encoder._learn: met.append(sum(map(len, new))) or own(kept, new, before))
    texts = [None, "", *drawn(5, 60), "long " + "w" * 1000, None, *drawn(6, 60), "é" * 149 + " ß", ""]
    for text, ids in zip(texts, encoder.encode(pa.array(texts, kind)), strict=True):
        assert ids.tolist() == whole(text), text
    assert sorted(met)[-2] <= 300 and max(met) == 1000  # the long text alone
    assert encoder.encode(pa.array([], kind)) == [] and encoder.encode(pa.array([None], kind))[0].tolist() == []


def test_memory_of_an_encoder_that_meets_ever_new_words():
    """Eight batches of 50,000 words, none met before."""
    encoder = PieceEncoder(PATH)
    draw = random.Random(7)
    fresh = iter("".join(draw.choice("etaoinsh") for _ in range(12)) for _ in range(400_000))
    batches = [pa.array([" ".join(next(fresh) for _ in range(100)) for _ in range(500)]) for _ in range(8)]
    tracemalloc.start()
    try:
        for batch in batches:
            encoder.encode(batch)
        held, most = (n / 1e6 for n in tracemalloc.get_traced_memory())
    finally:
        tracemalloc.stop()
    assert held < 40 and most < 45, (held, most)


class Counted:
    """A tokenizer that counts the words it merges."""

    def __init__(self, own):
        self.own, self.model, self.merged = own, self, 0

    def tokenize(self, word):
        self.merged += 1
        return self.own.model.tokenize(word)

    def encode_batch_fast(self, *args, **options):
        return self.own.encode_batch_fast(*args, **options)


def test_many_words_are_kept(whole):
    """200,000 words fit into what a worker keeps; met again, none is merged again."""
    draw = random.Random(8)
    words = list({"".join(draw.choice("etaoinsh") for _ in range(10)): None for _ in range(200_000)})
    texts = ["x " + " ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    encoder = PieceEncoder(PATH)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    for at in range(0, len(texts), 20):
        encoder.encode(texts[at : at + 20])
    assert counted.merged == len(words) + 1
    again = [t.replace(" ", "! ") for t in texts]
    got = [ids for at in range(0, len(again), 20) for ids in encoder.encode(again[at : at + 20])]
    assert counted.merged == len(words) + 1
    assert got[7].tolist() == whole(again[7])


def test_words_met_often_stay_when_others_go(whole):
    encoder = PieceEncoder(PATH, cache_bytes=60_000)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    draw = random.Random(9)
    usual = [f"usual{a}{b}" for a in "abcdefgh" for b in "éßabcdef"]
    for turn in range(40):
        fresh = ["".join(draw.choice("etaoinsh") for _ in range(12)) for _ in range(300)]
        before, text = counted.merged, " ".join(["x", *fresh, *usual])
        assert encoder.encode([text])[0].tolist() == whole(text)
        if turn > 1:
            assert counted.merged - before <= len(fresh), turn


def test_small_batches_are_joined(monkeypatch):
    monkeypatch.setattr(pieces, "TEXT_BYTES", 10)
    monkeypatch.setattr(pieces, "ROWS_AT_ONCE", 4)
    texts = [["abc"], ["défg", None], ["hij"], [], ["x" * 30], ["k", "l"], ["m", "n", "o"], [None], [""]]
    batches = [pa.record_batch([pa.array([at] * len(t), pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"]) for at, t in enumerate(texts)]
    joined = [batch.column(1).to_pylist() for batch in pieces.joined_batches(iter(batches), 1)]
    assert joined == [["abc", "défg", None], ["hij"], ["x" * 30], ["k", "l"], ["m", "n", "o", None], [""]]
    assert list(pieces.joined_batches(iter([]), 1)) == []
