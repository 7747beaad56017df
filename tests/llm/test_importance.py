import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistack.llm import importance

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(rows, target, percent=10, least=20, longest=1, seed=2024):
    """``(id, n_features, weight, score, rank)`` by the definition, sorted."""
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        for b in buckets(text, longest):
            s[b] += 1
    for text in target:
        for b in buckets(text, longest):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10_000) / ((x + 1) * (t.sum() + 10_000)))) for x, y in zip(s, t)]
    out = []
    for doc_id, text in rows:
        own = buckets(text, longest)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, len(words(text)) >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): k for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted(map(str, ((*r[:4], place.get(id(r))) for r in out)))


def test_crc_of_spans():
    rng = random.Random(2)
    data = np.frombuffer(rng.randbytes(300_000), np.uint8)
    spans = [(0, 1), (5, 64), (10, 65), (0, 300_000), (100, 128), (7, 129), (9, 99_991), (20, 4096), (20, 4097)]
    spans += [(rng.randrange(1000), rng.randint(1, 700)) for _ in range(500)]
    start, size = np.array(spans).T
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in spans]
    assert importance.span_crcs(data, start, size).tolist() == want
    assert importance.span_crcs(data, start[:1], size[:1]).tolist() == want[:1]
    assert importance.span_crcs(data, start[:0], size[:0]).tolist() == []


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_features(longest):
    rng = random.Random(4)
    texts = ["", " ", "A", "Ab-cD", "é漢 ÉA", "no\x00ne", "__", *("".join(rng.choice("aB9é漢 -_\n") for _ in range(rng.randrange(400))) for _ in range(200)), "x" * 5000 + " " + "y" * 70]
    row, bucket, n = importance.features([t.encode() for t in texts], longest)
    assert n.tolist() == [len(words(t)) for t in texts]
    assert sorted(zip(row.tolist(), bucket.tolist())) == sorted((i, b) for i, t in enumerate(texts) for b in buckets(t, longest))
    assert [len(x) for x in importance.features([], longest)] == [0, 0, 0]


def test_query_equals_the_definition(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance.op13_importance_resampling(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(docs, target)


def test_query_matches_sql(spark):
    import duckdb

    sql = importance.ORACLE
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"from {name}", f"from '{SF}/{name}.parquet'")
    want = duckdb.sql(sql).df().sort_values("doc_id")
    got = importance.op13_importance_resampling(spark, SF).toPandas().sort_values("doc_id")[list(want.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd, odd_rows, none, longest):
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100 + k, " ".join(f"w{(k * j) % 37}" for j in range(19 + k % 3))) for k in range(60)]
    more = spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumn("rank", F.lit("x")).withColumn("words", F.lit(1)).withColumn("weight", F.lit(1))
    target = ["w1 w2 w3", None, "w5"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, percent=35, longest=longest).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, target, 35, longest=longest)
    assert importance.resample(none, goal).collect() == []
    empty = importance.resample(docs, goal.limit(0), percent=35, longest=longest).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(str(tuple(r)) for r in empty.collect()) == by_hand(rows, [], 35, longest=longest)
