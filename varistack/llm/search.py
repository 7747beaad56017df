"""Exact BM25 top-k search over slices of the documents, with block-max dynamic pruning.

The collection's statistics (documents, mean length, document frequency of the queries' terms) are
computed once over all documents and given to every task, so a slice's scores are the global ones
and the slices' best merge exactly.

Documents are read and cut into words once: each slice of them is kept as an inverted index, postings
by term, its documents ordered so that those of like words and numbers of words share a block. Queries
are broadcast in blocks of bounded size, each block of them is one pass over the indexes.

In a pass, a first look at every 32nd slice gives each query a score that k documents reach. Scores are
then bounded per block of documents, for a batch of queries at once: the sparse terms' postings are added
up, for terms of many documents the block's largest impacts count. Blocks that stay under the query's
current k-th best score are skipped, the others' scores follow from a matrix product in single precision;
what may be among the k best, its error allowed for, is scored again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, give_back, slices, table
from varistack.llm.decontaminate import _SPACE, _ranges

K1, B = 1.2, 0.75
TOP_K = 10
BLOCK_DOCS = 64
#: Bounds of one broadcast block of queries.
QUERY_BLOCK, QUERY_TERMS = 4096, 2_000_000
LOW = 1e-9
#: Text and documents of one indexed slice: larger ones cost each query less, and memory more.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 16_384
#: Share of a slice's documents from which a term is added up densely; queries that are so treated at once.
HEAVY, QUERY_BATCH = 0.03, 512
#: Most dense terms of a slice, and most cells of its dense matrix.
DENSE_TERMS, DENSE_CELLS = 4096, 24 << 20
#: Groups of like documents in a slice; of so many slices one is looked at first.
GROUPS, FIRST_OF = 12, 32


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, number of a term, count) of a slice with the text in its second column, the texts' lengths, the terms.

    A term is the 64-bit hash of a word (as ``decontaminate.words_of`` cuts them).
    """
    import xxhash

    clean = [t.lower().encode("utf-8", "replace").translate(_SPACE).strip() if t else b"" for t in batch.column(1).to_pylist()]
    words = pc.ascii_split_whitespace(pa.array([t or None for t in clean], pa.binary()).cast(pa.string()))
    known = words.values.dictionary_encode()
    size, at = np.diff(words.offsets.to_numpy()).astype(np.int64), known.indices.to_numpy()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known.dictionary.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
    pair = np.sort(np.repeat(np.arange(len(size)), size) << 32 | at)
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    first = pair[new]
    return first >> 32, first & 0xFFFFFFFF, np.diff(np.append(new, len(pair))), size, hashes


def _dense_terms(frequency: np.ndarray, docs: int, share: float) -> np.ndarray:
    """Terms of at least a share of the documents, the most frequent ones if there are too many."""
    many = np.flatnonzero(frequency >= max(4, share * docs))
    most = min(DENSE_TERMS, DENSE_CELLS // max(1, docs))
    return many if len(many) <= most else np.sort(many[np.argsort(-frequency[many], kind="stable")[:most]])


def _order(row: np.ndarray, term: np.ndarray, docs: int, terms: int, share: float) -> np.ndarray:
    """An order of a slice's documents: groups of like words (k-means on cosines), by their number of dense terms.

    Only how well blocks are pruned depends on it.
    """
    dense = _dense_terms(np.bincount(term, minlength=terms), docs, share)
    place = np.full(terms, -1)
    place[dense] = np.arange(len(dense))
    pick = place[term] >= 0
    has = np.zeros((docs, len(dense)), np.float32)
    has[row[pick], place[term[pick]]] = 1
    number = has.sum(axis=1)
    has /= np.sqrt(np.maximum(number, 1))[:, None]
    known = np.flatnonzero(number)
    if len(known) <= GROUPS:
        return np.argsort(number, kind="stable")
    centre = has[np.random.default_rng(0).choice(known, GROUPS, replace=False)]
    for _ in range(5):
        group = (has @ centre.T).argmax(axis=1)
        centre = np.stack([has[group == g].sum(axis=0) for g in range(GROUPS)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-9)[:, None]
    return np.lexsort((number, group))


def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values, both not negative; in one sort of whole numbers where they fit into 63 bits."""
    bits = int(value.max(initial=0)).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 63:
        both = np.sort(key << bits | value)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key)
    return key[order], value[order]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "lz4", asbytes=True)


def _unpacked(x: pa.Scalar, number: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x.as_buffer(), number * np.dtype(kind).itemsize, "lz4"), kind)


INDEX = "slice long, ids array<{}>, size array<int>, term binary, many array<int>, doc binary, n binary"


def _indexes(share: float):
    """Texts to rows of :data:`INDEX`: the postings (document's place in the slice, count) of each distinct term in turn."""

    def index(bags: list[tuple], number: int) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(own[3]) for _, own in bags)])
        row = np.concatenate([own[0] + at for (_, own), at in zip(bags, starts)])
        term, number_of = np.unique(np.concatenate([own[4] for _, own in bags]), return_inverse=True)
        firsts = np.cumsum([0, *(len(own[4]) for _, own in bags)])
        at = np.concatenate([number_of[own[1] + first] for (_, own), first in zip(bags, firsts)])
        count, size = (np.concatenate([own[i] for _, own in bags]) for i in (2, 3))
        order = _order(row, at, len(size), len(term), share)
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        doc, count = _sorted(at * len(size) + place[row], count)
        doc %= len(size)
        many = np.bincount(at, minlength=len(term)).astype(np.int32)
        ids, size, many = (pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.concat_arrays([ids for ids, _ in bags]).take(pa.array(order)), pa.array(size[order].astype(np.int32)), pa.array(many)))
        term, doc, count = (pa.array([_packed(x)], pa.binary()) for x in (term, doc.astype(np.uint16), count.astype(np.int32)))
        return pa.record_batch([pa.array([number]), ids, size, term, many, doc, count], names=["slice", "ids", "size", "term", "many", "doc", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, own, docs, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for piece in slices(batches, most=SHARD_BYTES // 2):
            for a in range(0, piece.num_rows, SHARD_DOCS):
                part = piece.slice(a, SHARD_DOCS)
                if own and (docs + part.num_rows > SHARD_DOCS or size >= SHARD_BYTES):
                    yield index(own, number)
                    number, own, docs, size = number + 1, [], 0, 0
                bags = _bags(part)
                own.append((part.column(0), bags))
                docs, size = docs + part.num_rows, size + (pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
        if own:
            yield index(own, number)

    return run


def _arrays(batch: pa.RecordBatch, i: int) -> tuple:
    """Row i of :data:`INDEX`: ids, sizes, terms, postings a term, documents, counts."""
    ids, size, many = (batch.column(c)[i].values for c in ("ids", "size", "many"))
    many = many.to_numpy()
    term, doc, count = (_unpacked(batch.column(c)[i], n, kind) for c, n, kind in (("term", len(many), np.int64), ("doc", many.sum(), np.uint16), ("n", many.sum(), np.int32)))
    return ids.to_numpy(zero_copy_only=False), size.to_numpy(), term, many, doc, count


class ShardIndex:
    """Impacts of one slice: a dense matrix for heavy terms with block maxima, postings for the rest, both by document for exact scores."""

    def __init__(self, size: np.ndarray, term: np.ndarray, many: np.ndarray, doc: np.ndarray, count: np.ndarray, wanted: np.ndarray, mean: float, share: float, block_docs: int):
        at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
        keep = wanted[at] == term
        pick = np.repeat(keep, many)
        at, many, doc, count = at[keep], many[keep], doc[pick].astype(np.int64), count[pick]
        impact = count * (K1 + 1) / (count + K1 * (1 - B + B * size[doc] / mean))
        self.docs, self.blocks, self.block_docs = len(size), -(-len(size) // block_docs), block_docs
        frequency = np.zeros(len(wanted), np.int64)
        frequency[at] = many
        heavy = _dense_terms(frequency, self.docs, share)
        self.heavy = np.full(len(wanted), -1, np.int64)
        self.heavy[heavy] = np.arange(len(heavy))
        term = np.repeat(at, many)
        dense = self.heavy[term] >= 0
        self.dense = np.zeros((self.blocks * block_docs, len(heavy)), np.float32)
        self.dense[doc[dense], self.heavy[term[dense]]] = impact[dense]
        self.peak = self.dense.reshape(self.blocks, block_docs, len(heavy)).max(axis=1)
        #: Relative error of sums of positive terms in single precision, factors' rounding included.
        self.error = (len(heavy) + 16) * 2.0**-23
        frequency[heavy] = 0
        self.ptr = np.concatenate([[0], np.cumsum(frequency)])
        self.doc, self.impact = doc[~dense], impact[~dense]
        by_doc = np.argsort(doc.astype(np.uint16), kind="stable")
        self.own = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.docs))])
        self.own_term, self.own_impact = term[by_doc].astype(np.int32), impact[by_doc]

    def bounded(self, ptr: np.ndarray, term: np.ndarray, weight: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """(query, document) scores in single precision; -1 in blocks where none reaches the query's floor."""
        queries, width = len(ptr) - 1, self.blocks * self.block_docs
        own, dense = np.repeat(np.arange(queries), np.diff(ptr)), self.heavy[term]
        q = np.zeros((queries, self.dense.shape[1]), np.float32)
        q[own[dense >= 0], dense[dense >= 0]] = weight[dense >= 0]
        score = np.empty((queries, width), np.float32)
        for a in range(0, queries, 8):  # what is held of postings at once stays small
            b = min(a + 8, queries)
            t, w, row = (x[ptr[a] : ptr[b]] for x in (term, weight, own))
            many = self.ptr[t + 1] - self.ptr[t]
            post = _ranges(self.ptr[t], self.ptr[t + 1])
            score[a:b] = np.bincount(np.repeat((row - a) * width, many) + self.doc[post], np.repeat(w, many) * self.impact[post], (b - a) * width).reshape(b - a, width)
        by_block = score.reshape(queries, self.blocks, self.block_docs)
        upper = (q @ self.peak.T + by_block.max(axis=2)).astype(np.float64) * (1 + self.error)
        alive = (upper >= floors[:, None] - LOW) & (upper > 0)
        for block in np.flatnonzero(alive.any(axis=0)):
            row = np.flatnonzero(alive[:, block])
            by_block[row, block] += q[row] @ self.dense[block * self.block_docs : (block + 1) * self.block_docs].T
        by_block[~alive] = -1
        return score

    def best(self, ptr: np.ndarray, term: np.ndarray, weight: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query that has any: its number, documents that score at least its floor (at most those of the k best scores, ties included), and scores."""
        rough = self.bounded(ptr, term, weight, floors)
        least = np.maximum(floors * (1 - self.error) - LOW, 1e-38).astype(np.float32)
        hits = rough >= least[:, None]
        weights = np.zeros(len(self.heavy))
        for i in np.flatnonzero(hits.any(axis=1)):
            hit = np.flatnonzero(hits[i])
            if len(hit) > k:
                own = rough[i, hit].astype(np.float64)
                hit = hit[own >= np.partition(own, len(own) - k)[len(own) - k] * (1 - 2 * self.error) - LOW]
            at = slice(ptr[i], ptr[i + 1])
            weights[term[at]] = weight[at]
            post = _ranges(self.own[hit], self.own[hit + 1])
            yield i, hit, np.bincount(np.repeat(np.arange(len(hit)), self.own[hit + 1] - self.own[hit]), weights[self.own_term[post]] * self.own_impact[post], len(hit))
            weights[term[at]] = 0


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each query the k documents of the highest BM25 score.

    A query's terms count with their repeats. Only documents that share a term with it are found; equal scores
    (to nine decimals) rank by id. Null and empty texts match nothing; rows with a null id are left
    out on both sides; a repeated document row is found as often as it stands, a repeated query id is
    searched once, with the first of its texts.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.where(F.col(query_id).isNotNull()).groupBy(F.col(query_id).alias("id")).agg(F.min(query_text).alias("text"))
    kind, asked_kind = texts.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, at, count, _, term = _bags(batch)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(term[at]), pa.array(count)], names=["q", "term", "n"])

    vectors = checkpoint(asked.mapInArrow(bags, f"q {asked_kind}, term long, n long"))
    wanted = vectors.select("term").distinct()

    index = checkpoint(texts.mapInArrow(_indexes(HEAVY), INDEX.format(kind)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(known: list[tuple]) -> pa.RecordBatch:
            term, at = np.unique(np.concatenate([x[0] for x in known]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in known]), len(term)).astype(np.int64)
            return pa.record_batch([pa.array(term), pa.array(n), pa.nulls(len(term), pa.int64())], names=["term", "df", "words"])

        known, held, docs, words = [], 0, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                size, many = (batch.column(c)[i].values.to_numpy() for c in ("size", "many"))
                known.append((_unpacked(batch.column("term")[i], len(many), np.int64), many))
                held, docs, words = held + len(many), docs + len(size), words + int(size.sum(dtype=np.int64))
                if held > 1_000_000:
                    yield merged(known)
                    known, held = [], 0
        if known:
            yield merged(known)
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([docs]), pa.array([words])], names=["term", "df", "words"])

    counted = index.select("size", "term", "many").mapInArrow(frequencies, "term long, df long, words long")
    totals = checkpoint(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).join(wanted.withColumn("ask", F.lit(1)), "term", "left").where("ask = 1 or term is null").drop("ask"))
    whole = totals.where("term is null").first()
    schema = f"query_id {asked_kind}, id {kind}, score double"
    number = whole["df"] if whole else 0
    mean = max(1.0, (whole["words"] or 0) / max(1, number)) if whole else 1.0
    idf = F.log1p((F.lit(float(number)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = vectors.join(totals.where("term is not null"), "term").select("q", "term", (F.col("n") * idf).alias("w"))
    sizes = vectors.groupBy("q").agg(F.count("*").alias("terms"), F.sum("n"))
    n_queries, n_terms = sizes.agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0))).first()
    passes = max(1, -(-n_queries // QUERY_BLOCK), -(-n_terms // QUERY_TERMS))
    blocks = checkpoint(weighted.withColumn("pass", F.pmod(F.xxhash64("q"), F.lit(passes))))
    first = index.where(F.col("slice").isin([x.slice for x in index.select("slice").orderBy("slice").collect()][::FIRST_OF]))  # a row per slice
    share, block_docs, together = HEAVY, BLOCK_DOCS, QUERY_BATCH
    best_of = Window.partitionBy("query_id").orderBy(F.desc("score"))
    out = None
    for number_of in range(passes):
        got = blocks.where(F.col("pass") == number_of).select("q", "term", "w").toArrow()  # bounded, see QUERY_BLOCK
        q, term, w = (got.column(i).to_numpy() for i in range(3))
        order = np.lexsort((term, q))
        q, term, w = q[order], term[order], w[order]
        vocabulary = np.unique(term)
        asked_ids, start = np.unique(q, return_index=True)
        if not len(asked_ids):
            continue
        shared = spark.sparkContext.broadcast((asked_ids, np.append(start, len(q)), np.searchsorted(vocabulary, term), w, vocabulary))

        def scan(reached: dict, shared=shared):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                give_back()
                asked_ids, ptr, terms, weights, vocabulary = shared.value
                floors = np.array([reached.get(i, 0.0) for i in asked_ids.tolist()])
                heaps: list[tuple | None] = [None] * len(asked_ids)
                for batch in batches:
                    for at in range(batch.num_rows):
                        index = None  # the last slice's goes before the next one is made
                        ids, *arrays = _arrays(batch, at)
                        index = ShardIndex(*arrays, vocabulary, mean, share, block_docs)
                        del arrays
                        for a in range(0, len(asked_ids), together):
                            b = min(a + together, len(asked_ids))
                            own = slice(ptr[a], ptr[b])
                            for i, hit, score in index.best(ptr[a : b + 1] - ptr[a], terms[own], weights[own], floors[a:b], k):
                                own_ids, score = ids[hit], np.round(score, 9)
                                if heaps[a + i] is not None:
                                    own_ids, score = np.append(heaps[a + i][0], own_ids), np.append(heaps[a + i][1], score)
                                order = np.lexsort((own_ids, -score))[:k]
                                heaps[a + i] = own_ids[order], score[order]
                                if len(order) == k:
                                    floors[a + i] = max(floors[a + i], score[order[-1]])
                found = [i for i, h in enumerate(heaps) if h is not None]
                if found:
                    size = [len(heaps[i][0]) for i in found]
                    columns = [pa.array(np.repeat(asked_ids[found], size)), pa.array(np.concatenate([heaps[i][0] for i in found])), pa.array(np.concatenate([heaps[i][1] for i in found]))]
                    yield pa.record_batch(columns, names=["query_id", "id", "score"])
                give_back()

            return run

        seen = first.mapInArrow(scan({}), schema).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") == k)
        found = index.mapInArrow(scan({x.query_id: x.score for x in seen.select("query_id", "score").collect()}), schema)  # at most a row a query of the pass
        if passes > 1:  # one pass after another: its queries leave driver and executors before the next come
            found = checkpoint(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    # a query has at most k rows of each task; the window reads them sorted, without gathering them
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_bm25_topk(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries)
