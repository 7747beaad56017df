import zlib
from decimal import Decimal
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varistack.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def split(tokenizer, texts):
    ids, size = tokenizer.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if texts else []


def test_words_have_the_ids_of_whole_texts(tokenizer):
    texts = ["", "Heitsch... ÄCHST$$$ Où4x,, a.b@c7.de 192.0.2.7 AKIA12x= don't. (x) µm ª × x̂", "The cat. It's DON'T, straße où?", "x<|endoftext|>y z. <|STARTOFTEXT|>", "é ́a ΣΑΣ\x1ca b\x85c", "日本 語テ１２٣ ...!?a.b", "İstanbul ǅ ﬁ it 's", "a<|startoftext|>b"]
    own = packing.WordTokenizer(packing.default_tokenizer())
    got = split(own, texts)
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    clean = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = split(packing._tokenizer(packing.default_tokenizer()), clean)
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in clean]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_bound_and_packing(sizes):
    sizes = np.array(sizes)
    bins, offsets, rooms = packing.best_fit_decreasing(sizes, 60)
    assert packing.lower_bound(sizes, 60) <= len(rooms)
    for b in range(len(rooms)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()
        assert sizes[own].sum() + rooms[b] == 60


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.array([31, 31, 31]), 60) == 3


def sequences(rows):
    """Pieces per sequence after a check that each is gapless and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own][:-1]]).tolist() and sum(n for _, n in own) <= 4096
    return by


def test_exchange_keeps_every_piece(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 4097, 3000))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), part_rows=400).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    assert len(sequences(got)) <= 1.02 * packing.lower_bound(np.array([n for _, n in rows]))


@pytest.mark.parametrize("part_rows", [2, 3, 7, 20, 50])
def test_small_parts_never_get_worse(spark, part_rows):
    rng = np.random.default_rng(part_rows)
    lengths = [*rng.integers(1, 4097, 100).tolist(), *rng.integers(1, 300, 50).tolist()]
    rows = [(Decimal(i), int(n), (i, "x"), -1, True) for i, n in enumerate(lengths)]
    kinds = "doc_id decimal(20,0), length long, other struct<a: int, b: string>, sequence_id int, open boolean"
    frame = spark.createDataFrame(rows, kinds)
    got = packing.pack(frame, part_rows=part_rows).collect()
    assert sorted((r.doc_id, r.length, r.other, r.open) for r in got) == sorted((i, n, o, p) for i, n, o, _, p in rows)
    assert packing.lower_bound(np.array(lengths)) <= len(sequences(got)) <= len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=60), st.integers(2, 5), st.randoms())
def test_a_step_keeps_sequences_whole(sizes, parts, random):
    """Steps of one partition after another, without Spark: never more sequences, never a gap."""
    table, seen = pa.table({"length": pa.array(sizes, pa.int64())}), None
    for step in range(4):
        if step == 0:
            deal = [[i for i in range(len(sizes)) if i % parts == p] for p in range(parts)]
        else:
            home = {s: random.randrange(parts) for s in sorted(set(table[1].to_pylist()))}
            deal = [[i for i, s in enumerate(table[1].to_pylist()) if home[s] == p] for p in range(parts)]
        out = []
        for p, rows in enumerate(deal):
            with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda p=p: p)):
                out += list(packing._pack_partition(iter(table.take(pa.array(rows, pa.int64())).to_batches()), 0, 60, step))
        table = pa.Table.from_batches(out)
        by = {}
        for n, s, o, _ in zip(*(c.to_pylist() for c in table.columns)):
            by.setdefault(s, []).append((o, n))
        for own in by.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own][:-1]]).tolist() and sum(n for _, n in own) <= 60
        assert sorted(table[0].to_pylist()) == sorted(sizes) and (seen is None or len(by) <= seen)
        seen = len(by)


def test_pieces_and_odd_rows(spark, odd, none, tokenizer):
    got = packing.pack_documents(odd, packing.default_tokenizer(), with_ids=True).collect()
    texts = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.sequence_id, r.piece)):
        assert r.length == len(r.ids) <= 4096 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        texts.setdefault(r.doc_id, []).append(r)
    long = sorted((r for r in got if r.doc_id == 5), key=lambda r: r.piece)
    assert [r.piece for r in long] == list(range(len(long))) and [r.start for r in long] == [4096 * i for i in range(len(long))]
    text = next(r.text for r in odd.collect() if r.doc_id == 5)
    assert [i for r in long for i in r.ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert [list(r.ids) for r in got if r.doc_id in (3, 4, 6)] == [[1]] * 3
    assert sum(r.doc_id == 2 for r in got) == 2
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0
