"""Benchmark decontamination: BM25 index of the test items, searched with every training passage.

The inverted index holds the items, every document is a query. An item's score is BM25 with the index's
global statistics, divided by the item's score against itself: the share of its weight that the document
has. Shingles of five words of the item's question and of its answer must each be contained in the
document to 0.8, wherever they stand; of an item without a separate answer (column ``whole``) all shingles
together suffice, too. That bounds the score from below: if at most m distinct shingles of a text are
missing, at most m of its distinct terms are (each has a missing shingle of its own, that which ends with
the term right of the first shingle that is there, or starts with it left of that one). So an item that
can be verified scores at least 1 less its m heaviest terms: that is its threshold, and no verified item
is under it.

Search is block-max WAND in array form: of each item's m + 1 rarest terms one must be there, so their
postings name the blocks of items to look at; a block is dropped when the sum of its maxima of the
document's terms stays under the lowest threshold of its items; what is left is scored in full, and all
items above their thresholds are retrieved and verified.

Items come in shards of a bounded size, one pass over the documents each, with the statistics of all
items; a pass frees its index before the next one begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, slices, table

K1, B = 1.2, 0.75
SHINGLE, CONTAINMENT = 5, 0.8
BLOCK = 8
#: Bytes of items' texts in one shard of the index (a longer item makes its own).
SHARD_BYTES = 4 << 20

_SPACE = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text: the answer is the last sentence of two or
    more, or the second half of the words of a single one."""
    sentences = [s for s in text.replace("\n", " ").split(". ") if s.strip()]
    if len(sentences) > 1:
        return ". ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


class ItemIndex:
    """Postings of test items with normalised BM25 weights, block maxima and the items' thresholds."""

    def __init__(self, items: list[tuple], document_frequency: dict[bytes, int], n_items: int, mean_length: float, containment: float = CONTAINMENT):
        """``items``: (id, question, answer, whole) of this shard; the statistics are of all items."""
        self.ids, self.containment = [i for i, *_ in items], containment
        self.parts = [(words_of(q), words_of(a)) for _, q, a, _ in items]
        self.whole = [bool(whole) for *_, whole in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for q, a in self.parts for w in q + a}))}
        df = np.array([document_frequency.get(w, 0) for w in self.vocabulary], np.float64)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5)) if len(df) else df
        none = np.zeros(0, np.int64)
        terms, weights, rare, grams = [], [], [], []
        self.threshold = np.full(len(items), np.inf)
        for i, ((q, a), whole) in enumerate(zip(self.parts, self.whole)):
            numbers = [np.array([self.vocabulary[w] for w in part], np.int64) for part in (q, a)]
            own, count = np.unique(np.concatenate(numbers), return_counts=True)
            grams.append([np.unique(_grams(x)) for x in (*numbers, np.concatenate(numbers) if whole else none)])
            if len(own):
                score = count * (K1 + 1) / (count + K1 * (1 - B + B * count.sum() / mean_length)) * idf[own]
                score /= score.sum()
                spare = [self._spare(part) for part in (q, a, q + a)]
                lost = sum(_heaviest(score[np.isin(own, x)], m) for x, m in zip(numbers, spare))
                if whole:
                    lost = max(lost, _heaviest(score, spare[2]))
                self.threshold[i] = 1.0 - lost - 1e-9
                needed = max(spare[0] + spare[1], spare[2] if whole else 0) + 1
            terms.append(own), weights.append(score if len(own) else np.zeros(0)), rare.append(own[np.argsort(df[own], kind="stable")[:needed]] if len(own) else none)
        self.blocks = -(-len(items) // BLOCK)
        (self.term, self.ptr), self.weight = _ragged(terms, np.int64), _ragged(weights, np.float64)[0]
        item = np.repeat(np.arange(len(items)), np.diff(self.ptr))
        order = np.lexsort((self.term, item // BLOCK))
        block, term = item[order] // BLOCK, self.term[order]
        new = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(term) != 0)]) if len(term) else none
        self.block_term = term[new]
        self.block_max = np.maximum.reduceat(self.weight[order], new) if len(new) else np.zeros(0)
        self.block_ptr = np.searchsorted(block[new], np.arange(self.blocks + 1))
        self.block_least = np.array([self.threshold[b : b + BLOCK].min() for b in range(0, len(items), BLOCK)])
        named, at = _ragged(rare, np.int64)
        pairs = np.unique(named * max(1, self.blocks) + np.repeat(np.arange(len(items)), np.diff(at)) // BLOCK)
        self.rare_block = pairs % max(1, self.blocks)
        self.rare_ptr = np.searchsorted(pairs // max(1, self.blocks), np.arange(len(self.vocabulary) + 2))
        #: Hashes of the five-word shingles of each item's question, answer and whole text, in turn.
        self.gram, self.gram_ptr = _ragged([g for three in grams for g in three], np.uint64)

    def _spare(self, words: list[bytes]) -> int:
        """How many of a part's distinct shingles a document may lack."""
        return int((1 - self.containment) * len(_shingles(words)) + 1e-9)

    def candidates(self, ids: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(items, scores)`` of all items that reach their thresholds in a document.

        ``ids`` are its words as term numbers, the number of terms standing for others; ``there`` is an
        array of as many falses and one, to use and give back.
        """
        own = np.unique(ids)
        blocks = np.unique(self.rare_block[_ranges(self.rare_ptr[own], self.rare_ptr[own + 1])])
        if not len(blocks):
            return blocks, np.zeros(0)
        there[own] = True
        there[-1] = False
        at, size = _ranges(self.block_ptr[blocks], self.block_ptr[blocks + 1]), np.diff(self.block_ptr)[blocks]
        bound = np.bincount(np.repeat(np.arange(len(blocks)), size), self.block_max[at] * there[self.block_term[at]], len(blocks))
        blocks = blocks[bound >= self.block_least[blocks]]
        items = _ranges(blocks * BLOCK, np.minimum((blocks + 1) * BLOCK, len(self.ids)))
        at, size = _ranges(self.ptr[items], self.ptr[items + 1]), np.diff(self.ptr)[items]
        score = np.bincount(np.repeat(np.arange(len(items)), size), self.weight[at] * there[self.term[at]], len(items))
        there[own] = False
        held = score >= self.threshold[items]
        return items[held], score[held]

    def shingled(self, items: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of those items which may be verified by the hashes of their five-word shingles; shorter parts are not looked at."""
        own = np.unique(_grams(ids))
        part = (items[:, None] * 3 + np.arange(3)).ravel()
        at, size = _ranges(self.gram_ptr[part], self.gram_ptr[part + 1]), np.diff(self.gram_ptr)[part]
        held = np.isin(self.gram[at], own)
        share = np.bincount(np.repeat(np.arange(len(part)), size), held, len(part)) >= self.containment * size - 1e-9
        share = share.reshape(-1, 3)
        whole = np.array([self.whole[i] for i in items.tolist()], bool)
        return items[share[:, :2].all(1) | (whole & share[:, 2])]


def _heaviest(weights: np.ndarray, m: int) -> float:
    return float(np.sort(weights)[::-1][:m].sum())


def _ragged(parts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after another, and where each begins."""
    return np.concatenate([*parts, np.zeros(0, kind)]).astype(kind), np.cumsum([0, *map(len, parts)])


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five word numbers."""
    n = len(ids) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return out


def _shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _overlap(part: set[bytes], held: set[bytes], joined: bytes) -> float:
    """Share of a part's shingles that a text holds; a part of fewer words is one shingle, found as a phrase."""
    if len(part) == 1:
        return float(b" %b " % next(iter(part)) in joined)
    return len(part & held) / len(part) if part else 1.0


def _ranges(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    size = stop - begin
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - (end - size), size)


class Items:
    """Test items with their statistics, which are counted over all items on the executors; ``items`` has
    ``item_id``, ``question`` and ``answer``, and may have ``whole``: that the two are parts of one text.

    Null parts are empty, repeated rows count once.
    """

    def __init__(self, items: DataFrame, containment: float, shard_bytes: int):
        self.spark, self.containment = items.sparkSession, containment
        whole = F.coalesce("whole", F.lit(False)) if "whole" in items.columns else F.lit(False)
        known = items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), whole.alias("whole")).distinct()
        self.n, size = known.agg(F.count("*"), F.sum(F.octet_length("question") + F.octet_length("answer"))).first()
        self.shards = max(1, math.ceil((size or 0) / shard_bytes))

        def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [words_of(q) + words_of(a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                rows = [w for own in words for w in set(own)]
                yield pa.record_batch([pa.array(rows + [b""] * len(words), pa.binary()), pa.array([1] * len(rows) + [len(own) for own in words], pa.int64())], names=["term", "n"])

        self.counted = checkpoint(known.mapInArrow(stats, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")))
        self.known = known.withColumn("shard", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(self.shards)))

    def index(self, shard: int):
        """The broadcast index of one shard."""
        rows = self.known.where(F.col("shard") == shard).orderBy("item_id", "question", "answer", "whole").select("item_id", "question", "answer", "whole")
        rows = [tuple(r) for r in rows.collect()]  # about SHARD_BYTES
        terms = sorted({w for _, q, a, _ in rows for w in words_of(q) + words_of(a)})
        wanted = self.spark.createDataFrame([(bytearray(w),) for w in [*terms, b""]], "term binary")
        df = {bytes(r["term"]): r["n"] for r in self.counted.join(F.broadcast(wanted), "term").collect()}
        mean = df.pop(b"", 0) / max(1, self.n)
        return self.spark.sparkContext.broadcast(ItemIndex(rows, df, self.n, max(mean, 1.0), self.containment))


def matches(index: ItemIndex, texts: list[str | None]) -> Iterator[tuple]:
    """``(position, item id, score, question overlap, answer overlap)`` of the verified items of each text."""
    get, missing = index.vocabulary.get, len(index.vocabulary)
    there = np.zeros(missing + 1, bool)
    for row, text in enumerate(texts):
        words = words_of(text) if text else []
        ids = np.fromiter((get(w, missing) for w in words), np.int64, len(words))
        items, scores = index.candidates(ids, there)
        if not len(items):
            continue
        score = dict(zip(items.tolist(), scores.tolist()))
        near = index.shingled(items, ids).tolist()
        if not near:
            continue
        held, joined = _shingles(words), b" %b " % b" ".join(words)
        for i in near:
            (q, a), least = index.parts[i], index.containment
            question, answer = (_overlap(_shingles(part), held, joined) for part in (q, a))
            if min(question, answer) >= least or (index.whole[i] and _overlap(_shingles(q + a), held, joined) >= least):
                yield row, index.ids[i], score[i], question, answer


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(id_col, item_id, score, question_overlap, answer_overlap)`` per document and verified test item.

    Null texts are empty and match nothing, items without words match nothing; ids may be null; a
    repeated document row gives its rows again. Several shards are searched one after another, their rows checkpointed.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known, out = Items(items, containment, shard_bytes), None
    for shard in range(known.shards):
        index = known.index(shard)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = list(matches(index.value, batch.column(1).to_pylist()))
                if rows:
                    at, ids, *numbers = zip(*rows)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(ids), *(pa.array(x, pa.float64()) for x in numbers)]
                    yield pa.record_batch(columns, names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = texts.mapInArrow(run, f"id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
        if known.shards > 1:
            found = checkpoint(found)
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", containment: float = CONTAINMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows, whole, whose text holds no test item; see :func:`contaminated`.

    One shard filters the rows in place. Of several, each pass finds the texts that hold an item, and
    the rows are parted from their SHA-256 in the end.
    """
    known = Items(items, containment, shard_bytes)
    if known.shards == 1:
        index = known.index(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                held = {row for row, *_ in matches(index.value, texts)}
                yield batch.filter(pa.array([row not in held for row in range(len(texts))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    texts = docs.select(F.sha2(text_col, 256).alias("__text"), F.col(text_col).alias("text")).where("text <> ''")
    found = contaminated(texts, items, "__text", "text", containment, shard_bytes).select("__text").distinct()
    return docs.withColumn("__text", F.sha2(text_col, 256)).join(found, "__text", "left_anti").drop("__text")


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item_id, question, answer)`` of a table with one text per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [split_item(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([q for q, _ in both], pa.string()), pa.array([a for _, a in both], pa.string())], names=["item_id", "question", "answer"])

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, question string, answer string")


def whole_items_of(benchmark: DataFrame) -> DataFrame:
    """:func:`items_of`, with items that also count when their text as a whole is contained."""
    return items_of(benchmark).withColumn("whole", F.lit(True))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), whole_items_of(table(spark, sf_dir, "benchmark")))
