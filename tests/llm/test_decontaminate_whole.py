import corpus_pipeline
from varistack.llm import decontaminate as d

from .conftest import prose


def bench_rows():
    rows = [(i, f"{prose(200 + i, 25)}. {prose(300 + i, 10)}.") for i in range(20)]
    rows += [(30 + i, f"{prose(400 + i, 40)}. {prose(500 + i, 3)}.") for i in range(10)]  # a short closing sentence
    return rows + [(50, ""), (51, None), (52, "Short one. Yes indeed.")]


def corpus():
    rows = [(i, prose(i, 80)) for i in range(20)]
    for i, text in bench_rows()[:30]:
        words = text.split()
        around = prose(1000 + i, 50), prose(2000 + i, 50)
        changed = [*words[:12], "changed", *words[13:]]
        rows.append((100 + i, " ".join([around[0], *changed, around[1]])))
        rows.append((200 + i, " ".join([around[0], *words[:-1], "other", around[1]])))
        rows.append((300 + i, " ".join([around[0], *words[: len(words) // 2], around[1]])))
        cut = text.index(". ")
        rows.append((400 + i, f"{text[:cut]} {prose(3000 + i, 400)} {text[cut:]}"))  # the parts far apart
    return rows


def brute(docs, bench):
    """Containment of whole items, without the split; and the parts', for parts that stand apart."""
    out = set()
    for doc, text in docs:
        words = d.words_of(text or "")
        held, joined = d._shingles(words), b" " + b" ".join(words) + b" "
        for item, own in bench:
            whole = d._shingles(d.words_of(own or ""))
            parts = [d._shingles(d.words_of(p)) for p in d.split_item(own or "")]
            if whole and (d._overlap(whole, held, joined) >= 0.8 or all(d._overlap(p, held, joined) >= 0.8 for p in parts)):
                out.add((doc, item))
    return out


def test_whole_items(spark, tmp_path):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(corpus(), bench_rows())
    assert {(100 + i, i) for i in [*range(20), *range(30, 40)]} <= want and not any(300 <= doc < 400 for doc, _ in want)
    got = [(r.doc_id, r.item_id) for r in d.op5_decontaminate(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in corpus()} - {doc for doc, _ in want}


def test_parts_far_apart():
    question, answer = prose(1, 20), prose(2, 20)
    rows = [(1, question, answer, False)]
    words = d.words_of(question) + d.words_of(answer)
    index = d.ItemIndex(rows, {w: 1 for w in words}, 1, 40.0)
    found = list(d.matches(index, [f"{question} {prose(3, 900)} {answer}", None, f"{question} {prose(3, 900)}"]))
    assert [(f[0], f[1], *f[3:]) for f in found] == [(0, 1, 1.0, 1.0)] and abs(found[0][2] - 1) < 1e-9
