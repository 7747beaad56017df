"""The registered queries themselves, over the smallest tables, against plain statements of what they return."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from varistack.llm import packing, simhash
from varistack.llm.packing import op10_best_fit_packing
from varistack.llm.search import op1_bm25_topk
from varistack.llm.simhash import op2_simhash
from varistack.llm.suffix_dedup import op7_suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_asks_with_every_hundredth_row(spark, docs):
    got = op1_bm25_topk(spark, SF).collect()
    asked = {i for i in docs if i % 100 == 0 and docs[i].split()}
    names = set(got[0].asDict())
    query = next(n for n in names if n.startswith("query"))
    assert {r[query] for r in got} == asked and all(r.doc_id in docs for r in got)


def test_op2_fingerprints_and_components(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()}
    own = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{v:016x}" for i, v in own.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and (own[a] ^ own[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {i: c for i, (_, c) in got.items()} == {i: root(i) for i in ids}


def test_op7_cuts_what_an_earlier_document_has(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in op7_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    first, want = {}, {}
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 49):
            if first.setdefault(raw[at : at + 50], i) != i:
                gone[at : at + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\x00" + gone))
        want[i] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    assert got == want


def test_op10_packs_every_id_once(spark, docs):
    rows = op10_best_fit_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    assert pieces.keys() == docs.keys()
    for i, text in docs.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(raw))
            at += r.length
        assert at == len(ids) and all(r.length == 4096 for r in sorted(pieces[i], key=lambda r: r.piece)[:-1])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
