"""Importance resampling towards a target distribution, on hashed runs of words.

Each feature, a run of consecutive words, falls on the bucket crc32 % ``BUCKETS``. A bucket's gain is the
log ratio of its smoothed share in the target texts to that in all documents; a document's weight is
the mean gain of its features, and Gumbel noise on it makes the highest scores a draw without
replacement.

The CRC of a slice's features comes from one table: CRC is linear over XOR but for a constant of the
length, so a feature's value is the XOR, over its bytes, of what each byte adds at its distance from
the end, and ``bitwise_xor.reduceat`` takes it over all spans at once. Spans longer than the table are
cut into blocks from their ends, which are folded in pairs: the left one is advanced by the right one's
length, in as many rounds as the number of blocks has binary digits.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, slices, table
from varistack.sources.tables import dense_index

BUCKETS = 10_000
#: Distances from the end that the table covers; a power of two.
REACH = 64
ONES = np.uint32(0xFFFFFFFF)
#: Which bytes are part of a word: digits, small letters, all of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@functools.lru_cache(1)
def _table() -> np.ndarray:
    """What byte b adds at distance d from the end, flat at d * 256 + b."""
    by_byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        by_byte = np.where(by_byte & 1, by_byte >> 1 ^ np.uint32(0xEDB88320), by_byte >> 1)
    rows = [by_byte]
    for _ in range(REACH - 1):
        rows.append(rows[-1] >> np.uint32(8) ^ by_byte[rows[-1] & np.uint32(255)])
    return np.concatenate(rows)


def _applied(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear map, given by its values at the 32 single bits, of each state."""
    out = np.zeros(len(states), np.uint32)
    for bit in range(32):
        out ^= np.where(states >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@functools.lru_cache(64)
def _advance(power: int) -> np.ndarray:
    """The map of a state over 2 ** power zero bytes, by its values at the single bits."""
    single = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power:
        return _applied(_advance(power - 1), _advance(power - 1))
    return single >> np.uint32(8) ^ _table()[single & np.uint32(255)]


def _of_zeros(lengths: np.ndarray) -> np.ndarray:
    """CRC of as many zero bytes: the constants of the lengths."""
    distinct, at = np.unique(lengths, return_inverse=True)
    states = np.full(len(distinct), ONES)
    for power in range(int(distinct.max(initial=0)).bit_length()):
        states = np.where(distinct >> power & 1, _applied(_advance(power), states), states)
    return (states ^ ONES)[at]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (end - size), size)


def span_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC32 (as zlib's) of the spans of a byte array; spans may overlap, none is empty."""
    if not len(start):
        return np.zeros(0, np.uint32)
    blocks = -(-size // REACH)
    if (blocks == 1).all():
        of, begin, length = None, start, size
    else:  # block 0 is the last of its span
        of = np.repeat(np.arange(len(start)), blocks)
        number = np.repeat(blocks, blocks) - 1 - _spread(np.zeros_like(blocks), blocks)
        end = (start + size)[of] - number * REACH
        begin = np.maximum(end - REACH, start[of])
        length = end - begin
    distance = np.repeat(np.cumsum(length) - 1, length) - np.arange(int(length.sum()))
    values = _table()[distance << 8 | data[_spread(begin, length)]]
    states = np.bitwise_xor.reduceat(values, np.cumsum(length) - length)
    power = REACH.bit_length() - 1
    while of is not None and len(of) > len(start):
        odd = number & 1 == 1
        states[odd] = _applied(_advance(power), states[odd])
        number, power = number >> 1, power + 1
        first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(number) != 0)])
        states, of, number = np.bitwise_xor.reduceat(states, first), of[first], number[first]
    return states ^ _of_zeros(size)


def features(texts: list[bytes], longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, words)``: each feature's text and bucket, in no order, and each text's number of words."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    edge = np.flatnonzero(np.diff(np.r_[False, _WORD[data]].astype(np.int8), append=0))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(ends_of_texts, start, "right")
    words = np.bincount(row, minlength=len(texts))
    if longest > 1:  # words one space apart, so that runs are spans
        size = end - start + 1
        packed = np.full(int(size.sum()), 0x20, np.uint8)
        ends = np.cumsum(size)
        packed[_spread(ends - size, size - 1)] = data[_spread(start, size - 1)]
        data, start, end = packed, ends - size, ends - 1
    rows, buckets = [], []
    for n in range(1, longest + 1):
        whole = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        begin, length = start[whole], end[whole + n - 1] - start[whole]
        rows.append(row[whole]), buckets.append(span_crcs(data, begin, length) % np.uint32(BUCKETS))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), words


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1) -> np.ndarray:
    """How often each bucket occurs in all texts: each task sums its own, ``BUCKETS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            total += np.bincount(features(_bytes(batch.column(0)), longest)[1], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    every, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number from the sha256 of ``seed:id``, floored; a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """``(id_col, words, n_features, weight, score)``, one row per input row.

    A null text has no words; without features the weight is 0. Ids may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, bucket, words = features(_bytes(batch.column(1)), longest)
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, shared.value[bucket])
            weight = total // np.maximum(n, 1)
            drawn = np.fromiter((noise(i, seed) for i in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            columns = [batch.column(0), *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight, weight + drawn))]
            yield pa.record_batch(columns, names=["id", "words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """:func:`scores` of all documents with ``rank``: 1, 2, 3... for those drawn, by falling score, then smaller id; else null.

    Of the N documents of ``least_words`` or more, floor(percent * N / 100) are drawn. Features are runs
    of 1 to ``longest`` words. Null ids rank after others of their score; rows equal in score and id go by
    number of features and weight. Ranks come from a range-partitioned sort of five numbers per document, with
    no group: copies and hot sources are dealt like any other rows. An empty table gives an empty
    result; an empty target leaves smoothed shares. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, longest), bucket_counts(target, target_col, longest))
    rows = checkpoint(scores(docs, gain, id_col, text_col, longest, seed))  # ranges are found from a sample: texts are not read again for it
    order: list[Column] = [-F.col("score"), F.col(id_col).isNull(), F.col(id_col), F.col("n_features"), F.col("weight")]
    keys = {f"__by{i}": c for i, c in enumerate([F.col("words") < least_words, *order])}
    placed = dense_index(rows.withColumns(keys), *keys, name="__place")
    # documents of too few words stand last, so a place among the first is a rank
    drawn = placed.agg(F.floor(F.count(F.when(F.col("words") >= least_words, 1)) * percent / 100).cast("long")).first()[0]
    return placed.select(id_col, "words", "n_features", "weight", "score", F.when(F.col("__place") < drawn, F.col("__place") + 1).alias("rank"))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
with recursive step(n, value, turn) as (
  select n, n, 0 from range(256) t(n)
  union all
  select n, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end, turn + 1 from step where turn < 8
), crc_table as (select list(value order by n) as entries from step where turn = 8),
words_of as (
  select doc_id, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from (select doc_id, row_number() over () as id, text from documents union all select null, null, text from benchmark)
), spelt as (select distinct word, hex(encode(word)) as digits from words_of),
hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from spelt, crc_table
), counted as (select bucket, count(id) as s, count(*) - count(id) as t from words_of join hashed using (word) group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counted) + 10000)::double / ((s + 1)::double * ((select sum(t) from counted) + 10000)::double)))::bigint as gain from counted
), weighed as (
  select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from words_of join hashed using (word) join gain using (bucket) where id is not null group by id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score
  from (select doc_id, row_number() over () as id from documents) left join weighed using (id)
), placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place from scored)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and place <= (select 10 * count(*) // 100 from scored where n_features >= 20) then place end as rank
from placed
"""
