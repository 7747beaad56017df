import math
from collections import Counter

from varistack.llm import search as s
from varistack.llm.decontaminate import words_of

from .conftest import prose


def brute(docs, queries, k):
    bags = {i: Counter(words_of(t or "")) for i, t in docs}
    number, df = len(docs), Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / number
    out = {}
    for q, text in queries:
        scored = []
        for i, b in bags.items():
            length = sum(b.values())
            total = sum(n * math.log1p((number - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w, n in Counter(words_of(text or "")).items() if w in b)
            if total > 0:
                scored.append((-round(total, 9), i))
        out[q] = [(i, -x) for x, i in sorted(scored)[:k]]
    return out


def corpus():
    common = prose(1, 40).split()
    rows = [(i, " ".join([*prose(i % 90, 20).split(), *common[: i % 37], f"rare{i % 50}"])) for i in range(400)]
    return rows + [(900, ""), (901, None)]


def check(spark, rows, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = {}
    for r in s.search(docs, spark.createDataFrame(asked, "query_id long, text string"), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    want = brute(rows, asked, k)
    for q, own in want.items():
        mine = sorted(got.get(q, []))
        assert [x[0] for x in mine] == list(range(1, len(own) + 1))
        assert [x[1] for x in mine] == [i for i, _ in own]
        assert all(abs(a[2] - b[1]) < 1e-6 for a, b in zip(mine, own))


def test_matches_brute_force_with_ties(spark):
    check(spark, corpus(), 10)


def test_sparse_path_and_query_passes(spark, monkeypatch):
    monkeypatch.setattr(s, "HEAVY", 2.0)
    monkeypatch.setattr(s, "BLOCK_DOCS", 5)
    monkeypatch.setattr(s, "QUERY_BLOCK", 6)
    check(spark, corpus(), 7)


def test_odd_rows(spark, odd, none):
    asked = spark.createDataFrame([(1, "un mot"), (2, None), (None, "un"), (1, "zzz")], "query_id long, text string")
    got = s.search(odd, asked, 3).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 5)}
    assert s.search(none, asked).count() == 0 and s.search(odd, asked.limit(0)).count() == 0
    same = s.search(odd, odd.where("doc_id = 2").selectExpr("doc_id as query_id", "text"), 3).orderBy("rank").collect()
    assert [r.doc_id for r in same] == [1, 2, 2]


def test_many_slices_and_a_first_look(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_DOCS", 37)
    monkeypatch.setattr(s, "FIRST_OF", 3)
    monkeypatch.setattr(s, "BLOCK_DOCS", 4)
    monkeypatch.setattr(s, "QUERY_BATCH", 5)
    check(spark, corpus(), 10)
    check(spark, corpus(), 1)


def test_passes_read_the_documents_once(spark, monkeypatch):
    """Each pass of queries used to read, cut and index all documents anew."""
    monkeypatch.setattr(s, "QUERY_BLOCK", 6)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(counted, "doc_id long, text string")
    asked = spark.createDataFrame([r for r in rows if r[0] % 20 == 0], "query_id long, text string")
    assert s.search(docs, asked, 3).count() == 3 * 20 and read.value == len(rows)


def test_words_are_cut_alike():
    import pyarrow as pa
    import xxhash

    texts = ["", None, "  ", "!!", "A b  b\x0b\x1cc\x85d e f É é İ ß \x00 x", "日本 語 a-b_c", "a" * 50, "﻿ q \U0001f600 r"]
    row, at, n, size, term = s._bags(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]))
    for i, text in enumerate(texts):
        words = words_of(text or "")
        own = Counter({xxhash.xxh64_intdigest(w): c for w, c in Counter(words).items()})
        assert size[i] == len(words) and dict(zip(term[at[row == i]].astype("uint64").tolist(), n[row == i].tolist())) == own
