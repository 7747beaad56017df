import hashlib
import random

import numpy as np
import pytest

from varistack.llm import suffix_dedup
from varistack.llm.suffix_dedup import remove_repeats

from .conftest import prose


def brute(rows, size=50):
    low = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - size + 1):
            low[data[i : i + size]] = min(low.get(data[i : i + size], doc), doc)
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - size + 1):
            if low[data[i : i + size]] < doc:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        out[doc] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng, rows = random.Random(5), []
    shared = [prose(100 + i, 12) for i in range(6)]
    for i in range(60):
        parts = [prose(i, rng.randint(1, 30))]
        for _ in range(rng.randint(0, 3)):
            cut = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [cut[a : a + rng.randint(40, 80)], prose(1000 * i + a, 4)]
        rows.append((i, " é ".join(parts)))
    rows += [(60, "a" * 49), (61, "a" * 50), (62, "a" * 200), (63, "b" * 50), (64, None), (65, ""), (66, rows[3][1]), (67, rows[3][1]), (68, "ab" * 300), (69, "ab" * 100)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == brute(rows)


def test_many_groups_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one id are judged apart; a null id comes last."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    rows = [(i % 20 if i % 9 else None, text) for i, text in corpus()]
    ranked = [(10**9 if i is None else i, text) for i, text in rows]
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect())
    want, low = [], {}
    for i, text in ranked:
        data = (text or "").encode()
        for j in range(len(data) - 49):
            low[data[j : j + 50]] = min(low.get(data[j : j + 50], i), i)
    for i, text in ranked:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for j in range(len(data) - 49):
            if low[data[j : j + 50]] < i:
                gone[j : j + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        want.append((-1 if i == 10**9 else i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_equal_names_of_unequal_strings_are_told_apart(monkeypatch):
    text = np.frombuffer(b"x" * 60 + b"y" * 60, np.uint8)
    monkeypatch.setattr(suffix_dedup, "_names", lambda text, length: np.zeros(len(text) - length + 1, np.uint64))
    got = suffix_dedup._earlier(text, np.array([0, 60, 70]), np.array([1, 2, 3]), 50)
    assert got.tolist() == [False, False, True]


def test_odd_rows(spark, odd, none):
    got = remove_repeats(odd).collect()
    assert len(got) == odd.count()
    whole = [r for r in got if r.n_bytes > 0 and r.n_removed == r.n_bytes]
    assert sorted(str(r.doc_id) for r in whole) == ["2", "2", "None"]
    assert all(r.kept == b"" for r in whole)
    assert remove_repeats(none, digest=True).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(odd, threshold=8)


def test_keys_that_do_not_fit():
    assert suffix_dedup.key_shift(10, 1) == 0 and suffix_dedup.key_shift(10, 2) == 1 and suffix_dedup.key_shift(1 << 40, 1 << 23) == 23
    assert suffix_dedup.key_shift(3 << 24, (1 << 24) + 1) == 25
    with pytest.raises(ValueError, match="do not fit"):
        suffix_dedup.key_shift(1 << 34, 1 << 33)
