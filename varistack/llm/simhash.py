"""SimHash near-duplicate detection by multi-index hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 (seed 42) values of its word
shingles. Two fingerprints link when they differ in at most ``max_bits`` bits; documents in one
connected component are near-duplicates.

Search: the 64 bits are cut into segments. By the pigeonhole principle, two fingerprints at distance
<= d agree in at least one segment i up to r_i bits, whenever the sum of (r_i + 1) exceeds d. Each
fingerprint is stored once per segment under its exact segment value, and probes the table with every
value in the Hamming ball of radius r_i about its own. One-bit flips need only go from 0 to 1, as of
two values that differ in one bit exactly one has the 0. Matches are verified on all 64 bits.

Only distinct fingerprints enter the search, so a group of equal copies of any size costs one entry.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistack.llm import minhash
from varistack.llm.common import checkpoint, components, map_text

#: (lowest bit, bits, radius) of each segment: (1+1) + (1+1) + (0+1) = 5 > 4.
SEGMENTS = ((42, 22, 1), (20, 22, 1), (0, 20, 0))


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """Fingerprint of one UTF-8 text: A-Z lower-cased, words split at ASCII white space."""
    return _majority(minhash.shingle_hashes(data, shingle))


def _majority(values: np.ndarray) -> int:
    """The bits set in over half of the values; zero for none."""
    counts = np.zeros(64, np.int64)
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id_col, fp)``: one row per input row, fp the fingerprint's bits as a signed long.

    A null text counts as empty; its fingerprint is zero. Ids may be null or repeat.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        out = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(out)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _key(low: int, bits: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _flipped(key: Column, mask: Column) -> Column:
    return key.bitwiseXOR(mask)


def _in_segment(seg: int):
    return lambda value: F.struct(F.lit(seg).alias("seg"), value.alias("key"))


def links(distinct: DataFrame, max_bits: int = 4, segments: tuple = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits.

    Every such pair is found; a pair may come more than once.
    """
    if sum(r + 1 for *_, r in segments) <= max_bits:
        raise ValueError("the segments' radii do not cover max_bits")
    entries = [F.struct(F.lit(s).alias("seg"), _key(low, bits).alias("key")) for s, (low, bits, _) in enumerate(segments)]
    balls = []
    for s, (low, bits, radius) in enumerate(segments):
        key = _key(low, bits)
        if radius > 1:  # every key of the ball
            masks = F.lit([sum(1 << j for j in own) for r in range(radius + 1) for own in combinations(range(bits), r)])
            ball = F.transform(masks.cast("array<long>"), partial(_flipped, key))
        else:  # of two keys that differ in one bit, the one without it probes
            values = [key] + [F.when(key.bitwiseAND(F.lit(1 << j)) == 0, key.bitwiseOR(F.lit(1 << j))) for j in range(bits) if radius]
            ball = F.filter(F.array(*values), lambda v: v.isNotNull())
        balls.append(F.transform(ball, _in_segment(s)))
    stored = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*entries)).alias("e")).select("b", "e.seg", "e.key")
    probes = distinct.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*balls))).alias("e")).select("a", "e.seg", "e.key")
    found = probes.hint("merge").join(stored, ["seg", "key"]).where("a != b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return found.select("a", "b")


def segments_for(fingerprints: int) -> tuple:
    """Segments for 4 bits, by the number of distinct fingerprints.

    Candidates are about the square of that over 2 to the shortest segment's length: beyond some tens of
    millions, two halves with larger balls (529 and up to 33 probes) cost less than the candidates of three parts.
    """
    return SEGMENTS if fingerprints <= 1 << 26 else ((0, 32, 2), (32, 32, 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, segments: tuple | None = None) -> DataFrame:
    """``(id_col, fp, component_id)``: one row per input row; component_id is the smallest id reachable.

    Null ids take part but never name a component (a component of null ids alone has a null
    component_id). Repeated rows and ids are kept. An empty table gives an empty result.
    """
    return _linked(checkpoint(fingerprints(docs, id_col, text_col, shingle)), id_col, max_bits, segments)


def _linked(fps: DataFrame, id_col: str, max_bits: int = 4, segments: tuple | None = None) -> DataFrame:
    """:func:`near_duplicates` of fingerprints ``(id_col, fp)`` that are at hand."""
    classes = checkpoint(fps.groupBy("fp").agg(F.min(id_col).alias("low")))
    segments = segments or segments_for(classes.count())
    comp = components(links(classes.select("fp"), max_bits, segments))
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = comp.select(F.col("node").alias("fp"), "component").join(lowest, "component")
    # fingerprints without a link keep their own class's smallest id
    per_class = classes.join(linked.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    # cut off here, so that both sides of the join are dealt for it and Spark may split a fingerprint that many rows have
    return fps.join(checkpoint(per_class), "fp").select(id_col, "fp", "component_id")


def _signatures(shingle: int):
    """A map of ``(node, text)`` to node, distinct shingles, fingerprint and MinHash bands, from one pass of hashing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, bits, keys = [], [], [], []
        first = dict(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()))
        for node, text in first.items():
            values = minhash.shingle_hashes(text or b"", shingle)
            distinct = np.unique(values)
            nodes.append(node), sizes.append(len(distinct)), bits.append(_majority(values)), keys.append(minhash.band_keys(distinct))
        flat = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
        offsets = pa.array(np.arange(len(nodes) + 1) * minhash.BANDS, pa.int32())
        columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat)]
        return pa.record_batch(columns, names=["node", "n", "fp", "keys"])

    return run


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = minhash.SHINGLE, least: float = minhash.SIMILARITY) -> DataFrame:
    """The documents to keep: of each group of near copies the row with the smallest id, whole, with all its columns.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity of ``least``
    or more, and what such pairs join. Multi-index hashing finds the fingerprints within four bits; each
    text of a component is verified on the shingles against its first. Pairs farther apart in bits (at
    0.8 ten bits differ on average, too many for balls) come from MinHash bands, verified alike.

    A null text is empty, and texts without words are copies of each other. Rows with a null id come
    after all others; of rows with one id the smallest text hash wins, and of rows equal in id and
    text one stays.
    """
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, node = docs.withColumn("__row", order), F.xxhash64(text).alias("node")
    texts = docs.select(node, text.alias("text"))
    signed = checkpoint(map_text(texts, _signatures(shingle), "node long, n long, fp long, keys array<long>"))
    near = _linked(signed.select("node", "fp"), "node").where("node != component_id")
    joined = minhash.near_copies(texts, signed, near.select(F.col("component_id").alias("a"), F.col("node").alias("b")), least, shingle)
    classes = rows.select("__row", node).groupBy("node").agg(F.min("__row").alias("low"))
    keep = classes.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("low").alias("__keep"))
    # the struct itself is never null: plain equality deals rows as dropDuplicates needs them, so texts move once
    kept = rows.join(keep, F.col("__row") == F.col("__keep"), "left_semi")
    return kept.dropDuplicates(["__row"]).drop("__row")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from varistack.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
