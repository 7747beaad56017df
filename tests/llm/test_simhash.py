import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varistack.llm import simhash


def brute(fps):
    """Smallest index reachable over links of at most four bits."""
    low = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 4:
                    low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("number", [10, 1 << 30])
def test_links_are_those_of_brute_force(spark, number):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(25)]
    values = set(base)
    for b in base:
        for bits in (1, 2, 3, 4, 4, 5, 6):
            own = b
            for bit in rng.sample(range(64), bits):
                own ^= 1 << bit
            values.add(own)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), segments=simhash.segments_for(number)).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4}
    assert got == want


def test_components_on_chains_and_stars(spark):
    from varistack.llm.common import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_short_and_empty_texts():
    import xxhash

    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One  TWO\x0bthree") == xxhash.xxh64_intdigest(b"one two three", 42)


def test_fingerprint_counts_bits_of_repeated_shingles():
    import xxhash

    words = "a b c d a b c d e".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words).encode()) == want


def test_query_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["a b c d e f g"] * 3 + ["", None, "q r s t u v w x", "A B C D E F G"])]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    assert [got[i][0] & (1 << 64) - 1 for i, _ in rows] == fps
    assert [got[i][1] for i, _ in rows] == brute(fps)


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[6] == 3
    assert {r.component_id for r in got if r.doc_id is None} == {1, 3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    only_null = odd.where(F.col("doc_id").isNull())
    assert simhash.representatives(only_null).count() == 2
