"""Best-fit-decreasing sequence packing with bound-certified repacking.

1. Tokenise. A document's ids end with ``end_id``; documents longer than the capacity are cut into
   full pieces, the last of which may be shorter.
2. Deal the pieces out over partitions of about ``part_rows`` rows; pack each by best-fit decreasing.
3. A dual feasible function f maps sizes so that any set that fits one sequence has f-values of at
   most the capacity; the sum of f over the capacity, rounded up, is thus a lower bound on the
   sequences needed. The largest bound over two families of functions certifies a partition whose
   packing meets it.
4. Partitions with a gap exchange their sequences that have room left (a certified one gives only its
   emptiest): whole sequences are dealt anew by a hash of their number and the round, each partition
   runs best-fit decreasing over what it got, and takes the new packing only where it has fewer
   sequences. Rounds end when one wins nothing, when the bound of all sizes is met, or after one
   partition has held all that is open. The number of sequences never grows.

A task holds one partition's sizes, never its texts; no group grows with the data.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from varistack.llm.common import checkpoint, slices, table

CAPACITY = 4096
END_ID = 1
PART_ROWS = 100_000
#: Distinct parts of words whose ids a task keeps before it starts its cache anew.
CACHE_PARTS = 150_000


#: Words of Latin-1 letters, then ASCII punctuation; the pre-tokeniser parts the two.
_SIMPLE = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<tail>[!-/:-@\\[-`{-~]*)$"
#: The same alternatives for other words of Latin-1 letters, digits and ASCII punctuation but the apostrophe.
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Byte-level BPE spells each byte as a printable character: Latin-1's own where it is one, else from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i], ..., begin[i] + size[i] - 1 of every i in turn."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin - (end - size), size)


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never merges over white space.

    Texts are split at ASCII white space, which this tokenizer's normaliser and pre-tokeniser drop, and
    a slice's distinct words are encoded once, by the parts into which the pre-tokeniser cuts them.
    """

    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        probe = ["the", "tokenization", "straße", "où", "éàüñ", "7", "...", "$#$"]
        try:
            self.plain = all(self._part_ids(w) == self._whole_ids(w) for w in probe) and self._whole_ids("Où4x..") == [i for w in ("où", "4", "x", "..") for i in self._part_ids(w)]
        except Exception as refused:  # the model's own library raises bare exceptions
            if type(refused) is not Exception:
                raise
            self.plain = False
        self.clear()

    def clear(self):
        self.known: dict[str, list[int]] = {"": []}

    def _whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part_ids(self, part: str) -> list[int]:
        """Ids of one pre-token in lower case straight from the merge model, without normaliser and pre-tokeniser."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(part)]

    def _other_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words of any kind."""
        out: list[list[int] | None] = []
        rest = []
        for word in words:
            lower = word.lower() if word.isascii() else word
            runs = _RUNS.findall(lower) if self.plain and "<|" not in word else []
            if runs and sum(map(len, runs)) == len(word):
                out.append([i for run in runs for i in self._ids_of(run)])
            else:
                out.append(None)
                rest.append(word)
        ids = iter(self._separated_ids(rest))
        return [next(ids) if own is None else own for own in out]

    def _ids_of(self, part: str) -> list[int]:
        own = self.known.get(part)
        if own is None:
            own = self.known[part] = self._part_ids(part)
        return own

    def _separated_ids(self, words: list[str]) -> list[list[int]]:
        """A few hundred words at a call, with a special token between them."""
        out: list[list[int]] = []
        for at in range(0, len(words), 256):
            texts = words[at : at + 256]
            ids = np.array(self._whole_ids(self.SEPARATOR.join(texts)), np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.separator))
            if len(parts) == len(texts):
                out += [parts[0].tolist(), *(p[1:].tolist() for p in parts[1:])]
            else:  # a word holds the special token itself
                out += [self._whole_ids(t) for t in texts]
        return out

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, pointers)`` of distinct words."""
        if len(self.known) > CACHE_PARTS:
            self.clear()
        cut = pc.extract_regex(words, _SIMPLE) if self.plain else pa.nulls(len(words), pa.struct([("stem", words.type), ("tail", words.type)]))
        simple = cut.is_valid()
        parts = pa.concat_arrays([pc.utf8_lower(cut.field(0)).filter(simple), cut.field(1).filter(simple)]).dictionary_encode()
        coded = list(map(self._ids_of, parts.dictionary.to_pylist()))
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter((i for own in coded for i in own), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        stem, tail = np.split(parts.indices.to_numpy().astype(np.int64), 2)
        simple = simple.to_numpy(zero_copy_only=False)
        where = np.flatnonzero(simple)
        lengths = np.zeros(len(words), np.int64)
        lengths[where] = size[stem] + size[tail]
        other = np.flatnonzero(~simple)
        rest = self._other_ids(words.take(pa.array(other)).to_pylist())
        lengths[other] = np.fromiter(map(len, rest), np.int64, len(rest))
        pointers = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(int(pointers[-1]), np.uint32)
        for at, part in ((pointers[where], stem), (pointers[where] + size[stem], tail)):
            out[_spread(at, size[part])] = ids[_spread(begin[part], size[part])]
        out[_spread(pointers[other], lengths[other])] = np.fromiter((i for own in rest for i in own), np.uint32, int(lengths[other].sum()))
        return out, pointers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has. A null text is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        count = pc.list_value_length(words).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        ids, pointers = self._encode_words(coded.dictionary)
        at = coded.indices.to_numpy()
        size = np.diff(pointers)[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(count)
        return ids[_spread(pointers[at], size)], total[ends] - total[ends - count]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, which runs one task after another."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids])`` per piece of each document.

    A null or empty text has the end id alone. Every input row gives its pieces, repeated rows too.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in slices(batches):
            ids, size = tokenizer.encode(batch.column(1))
            ids, size = np.insert(ids, np.cumsum(size), end_id).astype("<u4"), size + 1
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = _spread(np.zeros(len(size), np.int64), count)
            length = np.minimum(capacity, size[row] - piece * capacity)
            ends = np.cumsum(length)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (piece * capacity, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)
        tokenizer.clear()  # the worker lives on, for other stages' tasks

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Sequences that any packing of ``sizes`` (each given once, or ``times``) needs, by dual feasible functions.

    Threshold functions: sizes over capacity - t count as the capacity, sizes under t as nothing.
    Rounding functions: x becomes floor((k + 1) x / capacity) * capacity / k unless (k + 1) x is a
    multiple of the capacity, when x stays.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, times, minlength=capacity + 1).astype(np.int64)
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    t = np.arange(0, capacity // 2 + 1)
    value = (number[-1] - number[capacity - t + 1]) * capacity + total[capacity - t + 1] - total[t]
    best = int(-(-int(value.max()) // capacity))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 65):
        scaled = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int((scaled * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, offset, room left per bin)``: each size goes, largest first, where least room remains.

    Bins are kept by their room, and a bit set over rooms gives the least sufficient one.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, rooms = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            own, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = own, capacity - room
        room -= size
        rooms[own] = room
        if room:
            if not by_room[room]:
                mask |= 1 << room
            by_room[room].append(own)
    return bins, offsets, np.array(rooms, np.int64)


#: Columns that a packed row has after its own: sequence, offset there, whether the sequence goes on to the exchange.
_STATE = ("sequence_id", "offset", "open")


def _pack_partition(batches: Iterator[pa.RecordBatch], length_at: int, capacity: int, step: int) -> Iterator[pa.RecordBatch]:
    """Pack the rows of one partition; those of a later step end with the columns of ``_STATE``."""
    from pyspark import TaskContext

    batches = list(batches)
    got = pa.Table.from_batches(batches) if batches else None
    if got is None or not len(got):
        return
    sizes = got.column(length_at).to_numpy().astype(np.int64)
    if sizes.min() < 1 or sizes.max() > capacity:
        raise ValueError(f"a length is not within 1 to {capacity}")
    own = got.num_columns - (len(_STATE) if step else 0)
    bins, offsets, rooms = best_fit_decreasing(sizes, capacity)
    numbers = (step << 48) + (TaskContext.get().partitionId() << 24) + bins
    if step:
        before, at = np.unique(got.column(own).to_numpy(), return_inverse=True)
        if len(rooms) >= len(before):  # keep what it was
            bins, offsets, numbers = at, got.column(own + 1).to_numpy(), got.column(own).to_numpy()
            rooms = capacity - np.bincount(at, sizes).astype(np.int64)
    free = rooms > 0
    if len(rooms) == lower_bound(sizes, capacity):
        free = (np.arange(len(rooms)) == np.argmax(rooms)) & free
    columns = [*got.columns[:own], pa.array(numbers), pa.array(offsets), pa.array(free[bins])]
    names = [f"c{i}" for i in range(len(columns))]
    yield from pa.table(columns, names=names).to_batches(1 << 15)


def pack(sized: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Every row is packed once, repeated rows too; an empty table gives an empty result; a length that
    is null or out of range raises. Columns of the input that have the names of the added ones are
    replaced. Sequence ids are unique numbers without further meaning.
    """
    sized = sized.drop("sequence_id", "offset")
    length_at = sized.columns.index("length")
    sized = checkpoint(sized.withColumn("length", F.when(F.col("length").isNull(), F.raise_error(F.lit("a length is null")).cast("bigint")).otherwise(F.col("length").cast("bigint"))))
    sizes = sized.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    rows = sum(r["n"] for r in sizes)
    bound = lower_bound(np.array([r["length"] for r in sizes], np.int64), capacity, np.array([r["n"] for r in sizes], np.int64))
    names = [f"c{i}" for i in range(len(sized.columns) + len(_STATE))]
    kinds = [*(f.dataType for f in sized.schema.fields), LongType(), LongType(), BooleanType()]
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])
    sequence, opened = names[-3], names[-1]
    done, pool, open_rows, step, closed = [], sized, rows, 0, 0
    while True:
        parts = max(1, math.ceil(open_rows / part_rows))
        if step == 0 or parts == 1:
            dealt = pool.repartition(parts)
        else:
            dealt = pool.repartition(parts, F.xxhash64(sequence, F.lit(step)))

        def run(batches, step=step):
            return _pack_partition(batches, length_at, capacity, step)

        packed = checkpoint(dealt.mapInArrow(run, schema))
        # a sequence's rows share a partition after this step and the next, and have one row at offset 0
        first = F.when(F.col(names[-2]) == 0, 1)
        now, open_rows, left = packed.agg(F.count(first), F.count_if(F.col(opened)), F.count(F.when(F.col(opened), first))).first()
        won = step == 0 or now < before
        if not open_rows or parts == 1 or not won or closed + now <= bound:
            done.append(packed)
            break
        done.append(packed.where(~F.col(opened)))
        pool, before, closed, step = packed.where(opened), left, closed + now - left, step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop(opened).toDF(*sized.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity, **options)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
