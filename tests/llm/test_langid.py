import random

from varistack.llm import langid


def sentence(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n)) + "."


EN = "the and which weather through thinking house water other things would should".split()
FR = "le les dans maison pour vous toujours être château beaucoup après français".split()
RU = "это дом вода погода человек сегодня очень хорошо".split()


def labelled(spark, n=40):
    rows = [(i, sentence(w, 30, i), lang) for i in range(n) for lang, w in (("en", EN), ("fr", FR), ("ru", RU))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_spans_of_mixed_text(spark):
    model = langid.train(labelled(spark))
    text = " ".join([*EN[:6], *FR[:6], "12", *RU[:5], *EN[:5]])
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, switch_penalty=3.0).first()
    spans = [(s.first, s.words, s.lang) for s in got.spans]
    assert [s[2] for s in spans] == ["en", "fr", "ru", "en"]
    assert sum(s[1] for s in spans) == len(text.split())


def test_viterbi_is_the_best_sequence(spark):
    from itertools import product

    import numpy as np

    model = langid.train(labelled(spark))
    own = langid.Labeller(model, 2.0)
    texts = ["the maison water les погода things", "vous", "", None, "house dans dans weather the le"]
    words, _, labels = own.label(texts)
    for w, got in zip(words, labels):
        scores = np.array([own.score[own.known[x]] for x in w]) if w else np.zeros((0, 3))

        def value(seq):
            return sum(float(scores[i, s]) for i, s in enumerate(seq)) - 2.0 * sum(a != b for a, b in zip(seq, seq[1:]))

        best = max((value(s) for s in product(range(3), repeat=len(w))), default=0.0)
        assert abs(value(got.tolist()) - best) < 1e-3


def test_held_out_accuracy(spark):
    model = langid.train(labelled(spark))
    rows = [(i, sentence(w, 8, 1000 + i), lang) for i in range(30) for lang, w in (("en", EN), ("fr", FR), ("ru", RU))]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([(3 * i + j, t) for j, (i, t, _) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    assert sum(got[3 * i + j] == lang for j, (i, _, lang) in enumerate(rows)) >= 0.95 * len(rows)


def test_odd_rows(spark, odd, none):
    model = langid.train(labelled(spark))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (3, 4, 6, 8)} == {3: "und", 4: "und", 6: "und", 8: "und"}
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred != "und" for r in got if r.doc_id in (1, 5, 7))
    assert langid.identify(none, model).count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 6, 8)").count() == 0 and kept.count() == 6
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"} and langid.keep_identified(odd, empty).count() == 0


def test_foreign_scripts_go(spark):
    model = langid.train(labelled(spark))
    docs = spark.createDataFrame([(1, "שלום עולם " * 5), (2, "the water " * 5), (3, "the water שלום עולם עולם עולם שלום עולם"), (4, "вода дом")], "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [2, 4]
    assert "und" not in {r.lang_pred for r in langid.identify(docs, model).collect()}


def test_many_languages(spark):
    """Over 127 languages, each of a word of its own."""
    words = {f"l{i:03d}": "".join(chr(97 + (i // 12**k) % 12 + k) for k in range(3)) * 3 for i in range(200)}
    rows = [(i, f"{w} {w} {w}", lang) for i, (lang, w) in enumerate(words.items())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(frame, langid.train(frame)).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) > 190


def test_query_matches_the_parts(spark, tmp_path):
    """The query's rows from training and labelling rows one by one, outside Spark's joins and filters."""
    import zlib

    rows = [(i, sentence(w, 25, i), lang if i % 7 else None) for i, (lang, w) in enumerate([("en", EN), ("fr", FR), ("ru", RU)] * 40)] + [(900, None, "en"), (901, "..", "fr"), (902, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in langid.op8_language_id(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert {i: r.held_out for i, r in got.items()} == held
    model = langid.train(spark.createDataFrame([r for r in rows if not held[r[0]]], "doc_id long, text string, lang string"))
    own = langid.Labeller(model)
    for i, text, _ in rows:
        _, (size,), (label,) = own.label([text])
        share = [sum(int(n) for n, x in zip(size, label) if x == k) for k in range(3)]
        want = model["langs"][share.index(max(share))] if sum(share) else "und"
        assert got[i].lang_pred == want and abs(got[i].score - (max(share) / sum(share) if sum(share) else 0.0)) < 1e-12
    right = [got[i].lang_pred == ("en", "fr", "ru")[i % 3] for i in range(120) if held[i]]
    assert sum(right) >= 0.95 * len(right)
