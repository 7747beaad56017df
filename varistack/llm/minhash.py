"""Near copies by exact Jaccard similarity of word shingles, beyond those that SimHash proposes.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least 0.8; texts
of fewer words are one shingle. The caller's proposals are verified first. Further candidates share all
``ROWS`` minima of one of ``BANDS`` bands: a pair at 0.8 is missed with probability (1 - 0.8^5)^22 =
0.00016, one at 0.85 with 0.000003. Every link is verified on the shingles themselves.

Candidates of a band key are checked in two rounds, so that a large group costs no square: first each
member against the key's smallest, and in larger groups also against one picked by a hash, another for every
key. The texts of keys whose members are not in one component yet are then joined exactly, by prefixes: their shingles are put in one order, rare ones first, and two texts
of similarity t share one among their first shares of 1 - t and 1 - 2t / (1 + t), with enough shingles
after it on both sides, and the parities of their shingles over 256 bits differ in no more bits than
their sets in shingles. So texts that only hold the same common passage make no pair. A pair left out
is in one component already, or less similar. Only texts with a shared key are moved, through a bitmap
of their hashes. Equal texts (by XXH64) are one node.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, components, let_go, shared_dir, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 22, 5
#: Bits of the broadcast bitmap: 16 a text in question, at most 16 MB; more texts only move more.
MOST_BITS = 1 << 27
#: Entries of a key from which its texts are checked against a second member.
HUBS_FROM = 8
#: Counters (8 MB) by which shingles are put in order; where shingles share one, only the order is less apt.
COUNTERS = 1 << 20
#: Longs of 64 parities each.
PARITIES = [f"parity_{i}" for i in range(4)]

_RNG = np.random.Generator(np.random.PCG64(42))
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MULTIPLY = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of one UTF-8 text: A-Z lower-cased, words split at ASCII white space."""
    words = data.lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included; none for a text without words."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(start, end[shingle - 1 :].tolist())], np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band from the minima of its rows' hash functions over the shingles' hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 512):
        mixed = values[at : at + 512, None] ^ _XOR
        mixed *= _MULTIPLY
        np.minimum(low, mixed.min(0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in low.reshape(BANDS, ROWS).T:
        keys ^= row
        keys *= _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)`` of the given nodes, and of a few others that share a bit of the bitmap."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * nodes.count()).bit_length()))
    at = nodes.select(F.col("node").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            held = shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            if held.any():
                yield batch.filter(pa.array(held.astype(bool)))

    return texts.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _similar(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts' similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(32)(lambda text: shingles(text.encode("utf-8", "replace"), shingle))
        for batch in slices(batches, "of_a"):
            held = [similarity(known(x), known(y)) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    first, second = (texts.select(F.col("node").alias(n), F.col("text").alias(f"of_{n}")) for n in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _count_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many of the texts hold a shingle, by the low bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                np.add.at(total, _counter(np.unique(shingle_hashes(text.encode("utf-8", "replace"), shingle))), 1)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["at", "texts"])

    found = texts.select("text").mapInArrow(run, "at long, texts long").groupBy("at").agg(F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["at"].to_numpy()] = found["texts"].to_numpy()
    return counts


def _counter(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(COUNTERS - 1)).astype(np.int64)


def _parities(values: np.ndarray) -> np.ndarray:
    """For each of 256 bits whether an odd number of the hashes falls on it."""
    held = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=64 * len(PARITIES)) & 1
    return np.packbits(held.astype(np.uint8)).view(np.int64)


def _prefixes(texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The first shingles of each text ``(node, component, text)``, rare ones first: ``rest`` shingles from it on, ``stored`` in the shorter prefix, the parities of all its shingles."""
    counts = texts.sparkSession.sparkContext.broadcast(_count_shingles(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for node, component, text in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.unique(shingle_hashes(text.encode("utf-8", "replace"), shingle))
                n = len(values)
                values = values[np.lexsort((values, counts.value[_counter(values)]))]
                long, short = (n - int(np.ceil(share * n - 1e-6)) + 1 for share in (least, 2 * least / (1 + least)))
                first = values[:long].view(np.int64)
                at = np.arange(len(first))
                whole = [np.full(len(first), x) for x in (node, component, n, *_parities(values))]
                rows.append((first, n - at, at < short, *whole))
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)

    names = ["token", "rest", "stored", "node", "component", "n", *PARITIES]
    kinds = ", ".join(f"{name} {'boolean' if name == 'stored' else 'long'}" for name in names)
    return texts.select("node", "component", "text").mapInArrow(run, kinds)


def _across(texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Pairs ``(a, b)`` of texts in different components, all those of similarity ``least`` among them."""
    entries = checkpoint(_prefixes(texts, least, shingle))
    share = least / (1 + least)
    # a component's texts of one size are one entry of a token until a partner is found; one text alone keeps its parities
    alone = [F.when(F.count("*") == 1, F.min(p)).alias(p) for p in PARITIES]
    groups = entries.groupBy("token", "component", "n").agg(F.max("rest").alias("rest"), F.max(F.when(F.col("stored"), F.col("rest"))).alias("stored_rest"), *alone)

    def side(rows: DataFrame, of: str, *names: str) -> DataFrame:
        return rows.select("token", *(F.col(name).alias(f"{name.removeprefix('stored_')}_{of}") for name in names))

    both = F.col("n_x") + F.col("n_y")
    enough = F.least("rest_x", "rest_y") >= share * both - 1e-6  # shingles that can be common
    differ = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITIES), F.lit(0))
    near = F.coalesce(differ <= (1 - 2 * share) * both + 1e-6, F.lit(True))
    x = side(groups, "x", "component", "n", "rest", *PARITIES)
    y = side(groups.where("stored_rest is not null"), "y", "component", "n", "stored_rest", *PARITIES)
    found = x.hint("merge").join(y, (x["token"] == y["token"]) & (F.col("component_x") != F.col("component_y")) & (F.col("n_y") <= F.col("n_x")) & enough & near)
    found = found.select(x["token"], "component_x", "n_x", "component_y", "n_y")
    of_x = side(entries, "x", "component", "n", "node", "rest", *PARITIES)
    of_y = side(entries.where("stored"), "y", "component", "n", "node", "rest", *PARITIES)
    pairs = found.join(of_x, ["token", "component_x", "n_x"]).join(of_y, ["token", "component_y", "n_y"]).where(enough & near)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_copies(texts: DataFrame, signed: DataFrame, proposed: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``(node, component)`` of the texts that have a near copy.

    ``texts`` has ``node`` and ``text``, nodes may repeat; ``signed`` has each node's number of distinct
    shingles ``n`` and band ``keys``; ``proposed`` holds pairs ``(a, b)`` of nodes to verify besides.
    """
    spark = texts.sparkSession
    banded = signed.select("node", "n", F.explode("keys").alias("key"))
    # dealt by another column first, so that the join deals both sides anew and can split hot keys
    keys = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.xxhash64("node", "key")).alias("hub"), F.count("*").alias("size"))
    keys = keys.where("low != high").select("key", "low", F.when(F.col("size") >= HUBS_FROM, F.col("hub")).otherwise(F.col("low")).alias("hub")).repartition("low")
    members = checkpoint(banded.hint("merge").join(keys, "key").select("key", "node", "n", "low", "hub").distinct())
    folder = f"{shared_dir(spark)}/near-{uuid.uuid4().hex}"
    asked = members.select("node").union(proposed.select("a")).union(proposed.select("b")).distinct()
    _texts_of(texts, asked).write.parquet(folder)
    let_go(spark)
    known = spark.read.parquet(folder)

    stars = members.select("node", F.explode(F.array("low", "hub")).alias("star")).where("node != star")
    stars = stars.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
    stars = checkpoint(stars.union(proposed.select(F.least("a", "b"), F.greatest("a", "b"))).distinct())
    joined = components(_similar(stars, known, least, shingle))
    let_go(spark)
    placed = members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    apart = placed.join(mixed, "key").select("node", "component").distinct()
    known.join(apart, "node").write.parquet(f"{folder}-apart")
    let_go(spark)
    across = _across(spark.read.parquet(f"{folder}-apart"), least, shingle).join(stars, ["a", "b"], "left_anti")
    more = _similar(checkpoint(across), known, least, shingle)
    let_go(spark)
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
