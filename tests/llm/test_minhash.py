import random
import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from varistack.llm import minhash as m
from varistack.llm import simhash
from varistack.llm.common import components, let_go

from .conftest import prose


def planted():
    """Texts with copies from 0.8 to 0.95, some just under, a chain, and a group of many near copies."""
    rng, rows = random.Random(5), []
    for i in range(60):
        words = prose(i, 300).split()
        rows.append((10 * i, " ".join(words)))
        for j, changes in enumerate((2, 4, 6, 7, 9, 12), 1):
            own = list(words)
            for k in range(changes):
                own[rng.randrange(len(own))] = f"new{i}x{j}x{k}"
            rows.append((10 * i + j, " ".join(own)))
    words = prose(900, 200).split()
    for step in range(6):  # each a copy of the one before, the last far from the first
        rows.append((2000 + step, " ".join(words)))
        words = ["w%d" % (step * 10 + k) for k in range(10)] + words[:-10]
    group = prose(901, 120).split()
    rows += [(3000 + i, " ".join([*group[:60], f"n{i}", *group[60:]])) for i in range(150)]
    return rows + [(4000, "One two"), (4001, "one  TWO"), (4002, "one two three"), (4003, ""), (4004, None), (4005, " \n")]


def brute(rows):
    own = {i: m.shingles((t or "").encode()) for i, t in rows}
    ids = sorted(own)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    values = []
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            value = m.similarity(own[x], own[y])
            if value >= 0.8:
                values.append(value)
                a, b = sorted((root(x), root(y)))
                top[b] = a
    return {i for i in ids if root(i) == i}, values


def test_stage_drops_near_copies_and_nothing_else(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, values = brute(rows)
    assert sum(v < 0.85 for v in values) > 20 and 60 < len(want) < 250
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_two_more_rows_of_one_text_change_nothing(spark, none):
    rows = planted()
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string")
    want, _ = brute(rows)
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted(want)
    assert simhash.representatives(none).count() == 0


def test_pairs_across_components_miss_none_and_leave_out_the_common_passage(spark):
    """Exact prefixes, positions and parities: all pairs at 0.8, by brute force, and few of those that share a passage only."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, texts = word(60), []
    texts += [" ".join(passage + word(30)) for _ in range(60)]
    for size in (1, 4, 5, 6, 9, 14, 19, 40, 70, 120, 150, 250, 400, 700, 900, 1500):
        own = word(size)
        for edits in (0, 1, 1, 2, 3, 5, 9):
            changed = list(own)
            for at in rng.integers(0, size, edits):
                changed[at] = word(1)[0]
            texts.append(" ".join(changed + word(edits // 2)))
    texts = [*dict.fromkeys(texts), "", " "]
    sets = [m.shingles(t.encode()) for t in texts]
    component = [i % 7 for i in range(len(texts))]
    want = {(i, j) for i, j in combinations(range(len(texts) - 2), 2) if component[i] != component[j] and m.similarity(sets[i], sets[j]) >= 0.8}
    rows = spark.createDataFrame([(i, component[i], t) for i, t in enumerate(texts)], "node long, component long, text string")
    found = {(r.a, r.b) for r in m._across(rows.repartition(5), 0.8, 5).collect()}
    assert len(want) > 40 and want <= found
    assert all(component[i] != component[j] for i, j in found)
    assert not any(i < 60 and j < 60 for i, j in found)


def test_rounds_leave_no_shuffle_files_of_earlier_ones(spark):
    """A long chain takes many rounds; what is kept of them is about one round's."""
    kept = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    let_go(spark)
    time.sleep(3)
    before = kept.size()
    chain = spark.range(3_000).select((F.col("id") * 7919 % 3_001).alias("a"), ((F.col("id") + 1) * 7919 % 3_001).alias("b"))
    found = components(chain)
    time.sleep(3)
    assert kept.size() - before < 12
    assert found.count() == 3_001 and found.where("component != 0").count() == 0
