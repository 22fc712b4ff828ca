from collections import Counter

import pytest

from lexivane.llm import exact

from .conftest import frame, odd_texts


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    found = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for doc_id in ids:
            found[(doc_id, keep, len(ids))] += 1
    return found


@pytest.mark.parametrize("key_bits", [128, 8])
def test_groups_equal_brute_force(spark, key_bits):
    """With 8 bits nearly all hashes collide and only the bytes tell texts apart."""
    rows = odd_texts() + [(100 + i, f"text {i % 37}") for i in range(400)]
    found = exact.exact_duplicates(frame(spark, rows), key_bits=key_bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == expected(rows)
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({lowered(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_rows_that_stay(spark, odd):
    left = exact.without_duplicates(odd).collect()
    texts = [lowered(r.text) for r in left]
    assert sorted(texts) == sorted({lowered(t) for _, t in odd_texts()})
    assert {r.doc_id for r in left if lowered(r.text) == "one two three four"} == {6}
    assert left[0].asDict().keys() == dict.fromkeys(odd.columns).keys()


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_LEAST", 10)
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(300)]
    found = exact.exact_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == expected(rows)


def test_empty(nothing):
    assert exact.exact_duplicates(nothing).count() == 0
    assert exact.without_duplicates(nothing).count() == 0
