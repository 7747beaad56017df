from pathlib import Path

import corpus_pipeline
from varistack.llm import decontaminate, langid, packing, secrets, simhash

from .conftest import prose


def test_stages_in_a_row(spark, tmp_path):
    base = [(i, prose(i, 70), "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    item = f"{prose(777, 25)}. {prose(778, 10)}."
    extra = [(100, base[3][1], "xx", "s", 1), (101, f"{prose(5000, 60)} {item} {prose(5001, 60)}", "xx", "s", 1), (102, "12 34 56", None, "s", 1), (103, f'{prose(6000, 50)} token = "0123456789abcdef0123"', "yy", "s", 1), (104, None, None, None, None)]
    docs = spark.createDataFrame(base + extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in now.collect()})
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    everyone = {r[0] for r in base + extra}
    assert seen[0] == everyone - {102, 104}
    assert seen[1] == seen[0] - {100}
    assert seen[2] == seen[1] - {101}
    assert seen[3] == seen[4] == seen[2]
    after = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "secret_scan")).collect()}
    assert "[SECRET]" in after[103] and all(after[r[0]] == r[1] for r in base)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == seen[4] and whole.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_stages_call_the_operators(spark, none, monkeypatch):
    called = []
    for module, name in ((langid, "train"), (langid, "keep_identified"), (simhash, "representatives"), (decontaminate, "whole_items_of"), (decontaminate, "decontaminate"), (secrets, "redact"), (packing, "pack_documents")):
        monkeypatch.setattr(module, name, lambda docs, *_, name=name: called.append(name) or docs)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: none)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, none, "")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    assert called == ["train", "keep_identified", "representatives", "whole_items_of", "decontaminate", "redact", "pack_documents"]


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows and ids, a very long text, extra columns named like the operators' own."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"{prose(777, 25)}. {prose(778, 10)}."), (2, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = odd, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(str(r.doc_id) for r in now.collect()))
        if name != "best_fit_packing":
            assert now.columns == odd.columns
    assert kept[0] == ["1", "2", "2", "5", "7", "None"]
    assert kept[1] == kept[2] == kept[3] == ["1", "5", "7"]
    assert set(kept[4]) == {"1", "5", "7"} and kept[4].count("5") > 1
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept[4]
    left = [p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("pipeline-*/*")]
    assert "language_id" not in left and "secret_scan" in left
