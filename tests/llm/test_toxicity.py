import random

import numpy as np

from varistack.llm import toxicity

WORDS = "house water tree people walk morning river stone light garden bread".split()
BAD = "scumbag vermin lowlife".split()


def text(seed, bad, term=None):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(20)]
    if bad:
        words[rng.randrange(20)] = rng.choice(BAD)
    if term:
        words[0] = term
    return " ".join(words)


def tables(spark, n=300):
    # toxic texts mention one group far more often than neutral ones do
    rows = [(i, text(i, i % 3 == 0, "muslim" if i % 3 == 0 and i % 2 else "christian" if i % 7 == 1 else None)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def scores(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return np.array([r.score for r in sorted(toxicity.score(df, model).collect(), key=lambda r: r.doc_id)])


def test_held_out_texts(spark):
    model = toxicity.train(*tables(spark))
    assert (scores(spark, model, [text(5000 + i, True) for i in range(20)]) >= 0.3).all()
    assert (scores(spark, model, [text(6000 + i, False) for i in range(20)]) < 0.3).all()


def test_counterfactual_penalty_evens_out_groups(spark):
    docs, labels = tables(spark)
    pair = [text(9, False, "muslim"), text(9, False, "hindu")]

    def logit_gap(weight):
        s = scores(spark, toxicity.train(docs, labels, counterfactual=weight), pair)
        a, b = np.log(s / (1 - s))
        return abs(a - b)

    assert logit_gap(5.0) < 0.5 * logit_gap(0.0)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (5, None), (3, 0), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(none, labels)
    assert all(r.score < 0.3 for r in toxicity.score(odd, empty).collect())


def test_query_follows_its_contract(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {d.doc_id for d in docs}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    # a score is a function of the text alone: copies agree, and whoever reads the table anew gets the same
    by_text = {}
    for d in docs:
        assert by_text.setdefault(d.text or "", got[d.doc_id].score) == got[d.doc_id].score


def test_sample_does_not_hang_on_partitions(spark):
    docs, labels = tables(spark, 60)
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' again') AS text")).union(docs.selectExpr("doc_id", "concat(text, ' and again') AS text"))
    one, two = (toxicity.train(d, labels, max_rows=40) for d in (twice.repartition(1), twice.repartition(7)))
    assert np.array_equal(one["weights"], two["weights"]) and one["bias"] == two["bias"]


def test_neutral_mentions_of_groups(spark):
    """Neutral texts that the fit has not seen: naming a group makes none of them toxic."""
    model = toxicity.train(*tables(spark))
    named = [text(7000 + i, False, group) for i in range(12) for group in ("muslim", "christian", "hindu")]
    assert (scores(spark, model, named) >= 0.3).mean() == 0.0
