"""A corpus pipeline of five operators: each stage takes what its predecessor kept.

Language ID drops texts in no language, near-copy removal leaves one document of each group whose
five-word shingles have a Jaccard similarity of 0.8 or more (SimHash by multi-index hashing, MinHash
bands for pairs beyond its balls, every link verified),
decontamination drops documents with benchmark items, the secret scan redacts what it finds, and
packing lays the rest out in token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from varistack.llm import decontaminate, langid, packing, secrets, simhash
from varistack.llm.common import shared_dir, table
from varistack.sources.package import ship_package
from varistack.sources.tables import remove_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language, whole. Null and empty texts, and those without letters, go; repeated
    rows and ids stay as they are. The model learns from the rows' own text and lang; without any, no row stays."""
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id. Null texts count as empty, texts without
    words as copies of each other; null ids come last; of rows equal in id and text one stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whole. Null and empty texts hold none; each of repeated rows is judged alike."""
    return decontaminate.decontaminate(docs, decontaminate.whole_items_of(table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts redacted. A null text stays null; repeated rows and ids stay as they are."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each row's text and its place in a sequence. A null or empty text is one piece, of the
    end token alone; repeated rows and ids have pieces of their own."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, fingerprints and packing are beyond SQL; the tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again. An empty table gives an empty result; extra columns pass through all but the last."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # the last stage's input stays, as its rows are read when they are asked for
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
