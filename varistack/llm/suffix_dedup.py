"""Removal of byte strings that an earlier document already holds, by pruned prefix doubling.

Every position carries a name for the bytes that start there. Names of length 2h come from the pair
of names of length h at the position and at the offset h; positions whose name no other document
shares are unique and leave; the rest go on until the names reach the threshold of 50 bytes. Two
rounds cross the network, the shorter offsets are named inside the task that holds the text:

* Round 1, 16 bytes. Any 50-byte string contains 35 names of 16 bytes; the smallest of them is its
  anchor. Equal strings have equal anchors wherever they stand, so a string whose anchor no other
  document has is unique. Only anchors travel, about one per 18 bytes. Documents are grouped by a
  hash of their id; of equal texts in a slice only the smallest id sends anchors.
* Round 2, 50 bytes. Runs of positions with a shared anchor travel as text, keyed by the anchor; runs of
  one text go once per document group, with the places that hold them (two overlapping 50-byte names
  tell them apart). A bucket of anchors names the 50-byte strings of its distinct runs at offsets 16, 32
  and 18, sorts (name, earliest document) pairs, compares the bytes of equal names, and reports the
  positions that an earlier document has. Of one run's places all but the earliest are repeats as a whole.

Rows are known by a key of their own whose upper part has the order of the ids, so rows that share an id
are judged apart and never remove from each other.

A last pass over the documents cuts the reported bytes out. The dense form of prefix doubling would
send a row for each byte of the corpus in each of six rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, slices, table
from varistack.sources.tables import dense_index

THRESHOLD = 50
PREFIX = 16
#: Text that one document group, and about the text whose anchors one bucket, holds.
GROUP_BYTES = 8 << 20
#: Text that is named at once; a longer document is taken alone.
CHUNK_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max
#: Bits of a row's key, less its sign.
KEY_BITS = 63

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BYTE_NAMES = (np.arange(1, 257, dtype=np.uint64) * _A) ^ (np.arange(1, 257, dtype=np.uint64) * _B >> np.uint64(31))


def _join_names(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of a doubled (or overlapping) prefix from the pairs (name, name at the offset)."""
    out = names[:-offset] * _A
    out += names[offset:] * _B
    out ^= out >> np.uint64(29)
    out *= _C
    out ^= out >> np.uint64(32)
    return out


def _names(text: np.ndarray, length: int) -> np.ndarray:
    """Names of all substrings of ``length`` bytes; position p names text[p : p + length]."""
    names, have = _BYTE_NAMES[text], 1
    while have < length:
        step = min(have, length - have)
        if len(names) <= step:
            return names[:0]
        names, have = _join_names(names, step), have + step
    return names


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = np.minimum(values[:-step], values[step:]), have + step
    return values


def _anchor_runs(text: np.ndarray, size: np.ndarray, threshold: int, prefix: int):
    """Runs of window starts with one anchor: ``(doc index, first, last, anchor key)``.

    ``text`` is the concatenation of documents of the given sizes; no window crosses two of them.
    """
    none = np.zeros(0, np.int64)
    if len(text) < threshold:
        return none, none, none, none.astype(np.uint64)
    anchor = _window_min(_names(text, prefix), threshold - prefix + 1)
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - threshold + 1, 0))
    start = np.arange(len(doc)) + np.repeat((end - size) - np.concatenate([[0], np.cumsum(np.maximum(size - threshold + 1, 0))[:-1]]), np.maximum(size - threshold + 1, 0))
    if not len(doc):
        return none, none, none, none.astype(np.uint64)
    value = anchor[start]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    key = value[first] * _B
    key ^= key >> np.uint64(32)
    return doc[first], start[first], start[last], key * _A


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return zip(cuts[:-1], cuts[1:])


def _concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32)


def _pack(target: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows ``(target, doc ids, entries per doc, columns...)`` as bytes, one per target."""
    order = np.lexsort((doc, target))
    target, doc, columns = target[order], doc[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else []
    for a, b in zip(cuts, [*cuts[1:], len(target)]):
        ids, count = np.unique(doc[a:b], return_counts=True)
        yield (int(target[a]), ids.tobytes(), count.astype(np.uint32).tobytes(), *(c[a:b].tobytes() for c in columns))


def _unpack(batch: pa.Table, kinds: list) -> list[np.ndarray]:
    """Inverse of :func:`_pack` over all rows: ``[doc of each entry, columns...]``."""
    ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
    count = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
    return [np.repeat(ids, count), *(np.frombuffer(b"".join(batch.column(3 + i).to_pylist()), kind) for i, kind in enumerate(kinds))]


_ROW = "target int, ids binary, counts binary, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.Table:
    fill = [(*r, *[b""] * (6 - len(r))) for r in rows]
    columns = list(zip(*fill)) if fill else [[]] * 6
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["target", "ids", "counts", "a", "b", "c"])


def _send_anchors(buckets: int, threshold: int, prefix: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            low: dict[bytes, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < threshold:
                    continue
                own = low.get(text)
                if own is None or own[0] >> shift > doc >> shift:
                    low[text] = [doc]
                elif own[0] >> shift == doc >> shift:
                    own.append(doc)
            texts = [t for t, own in low.items() for _ in own]
            docs = np.array([d for own in low.values() for d in own], np.int64)
            found = []
            for a, b in _chunks(np.fromiter(map(len, texts), np.int64, len(texts))) if texts else []:
                own, *_, key = _anchor_runs(*_concat(texts[a:b]), threshold, prefix)
                order = np.lexsort((key, own))
                own, key = own[order], key[order]
                once = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])]) if len(own) else []
                found.append((docs[a:b][own[once]], key[once]))
            if found:
                doc, key = (np.concatenate(x) for x in zip(*found))
                bucket, short = _split(key, buckets)
                yield from _rows(list(_pack(bucket, doc, short))).to_batches()

    return run


def _shared_anchors(groups_of, buckets: int):
    def run(key, batch):
        doc, short = _unpack(batch, [np.uint32])
        order = np.lexsort((doc, short))
        d, s = doc[order], short[order]
        begins = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        last = np.concatenate([first[1:], [len(s)]]) - 1
        shared = (d[first] != d[last])[at]
        d, s = d[shared], s[shared]
        full = np.full(len(s), key[0].as_py(), np.uint32)
        return _rows(list(_pack(groups_of(d), d, full, s)))

    return run


def _hash_group(groups: int):
    def of(doc: np.ndarray) -> np.ndarray:
        mixed = doc.astype(np.uint64) * _A
        mixed ^= mixed >> np.uint64(32)
        return (mixed * _B >> np.uint64(20)) % np.uint64(groups)

    return of


def _send_runs(buckets: int, threshold: int, prefix: int):
    def run(key, docs, flags):
        is_copy = np.array([x is not None for x in flags.column(6).to_pylist()], bool)
        skip = set(flags.column(6).filter(pa.array(is_copy)).to_pylist())
        doc, bucket, short = _unpack(flags.filter(pa.array(~is_copy)), [np.uint32, np.uint32])
        flagged: dict[int, np.ndarray] = {}
        both = bucket.astype(np.uint64) << np.uint64(32) | short
        order = np.argsort(doc, kind="stable")
        doc, both = doc[order], both[order]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist() if len(doc) else []
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            flagged[int(doc[a])] = np.sort(both[a:b])
        chosen = {(d, t) for d, t in zip(docs.column("doc").to_pylist(), docs.column("text").to_pylist()) if d in flagged and d not in skip}
        ids, texts = [d for d, _ in chosen], [t for _, t in chosen]
        rows: list[tuple] = []
        for a, b in _chunks(np.fromiter(map(len, texts), np.int64, len(texts))) if texts else []:
            text, size = _concat(texts[a:b])
            own, first, last, anchor = _anchor_runs(text, size, threshold, prefix)
            bucket, short = _split(anchor, buckets)
            pair = bucket.astype(np.uint64) << np.uint64(32) | short
            keep = np.zeros(len(own), bool)
            bounds = np.searchsorted(own, np.arange(b - a + 1))
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
                if y > x:
                    marks = flagged[ids[a + i]]
                    at = np.minimum(np.searchsorted(marks, pair[x:y]), len(marks) - 1)
                    keep[x:y] = marks[at] == pair[x:y]
            own, first, last, bucket = own[keep], first[keep], last[keep], bucket[keep]
            if not len(own):
                continue
            base = np.cumsum(size) - size
            named = np.array(ids[a:b], np.int64)[own]
            # a run is shorter than two thresholds: the names at its ends cover it
            name = _names(text, threshold)
            order = np.lexsort((named, last - first, name[last], name[first], bucket))
            own, first, last, bucket, named = own[order], first[order], last[order], bucket[order], named[order]
            head, tail, length = name[first], name[last], last - first + threshold
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]) | (length[1:] != length[:-1])])
            begin = np.flatnonzero(new)
            places = np.diff(np.append(begin, len(new)))
            sizes = length[begin]
            ends = np.cumsum(sizes)
            bytes_ = text[np.arange(int(ends[-1])) + np.repeat(first[begin] - (ends - sizes), sizes)].tobytes()
            offset = (first - base[own]).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[begin]) != 0])).tolist()
            for p, q in zip(cuts, [*cuts[1:], len(begin)]):
                x, y = int(begin[p]), int(begin[q]) if q < len(begin) else len(new)
                from_, to = int(ends[p] - sizes[p]), int(ends[q - 1])
                rows.append((int(bucket[x]), named[x:y].tobytes(), places[p:q].astype(np.uint32).tobytes(), offset[x:y].tobytes(), sizes[p:q].astype(np.int64).tobytes(), bytes_[from_:to]))
        return _rows(rows)

    return run


def _earlier(text: np.ndarray, start: np.ndarray, doc: np.ndarray, threshold: int) -> np.ndarray:
    """Which of the substrings at ``start`` a document of a smaller rank has, too (exact); ``doc`` are ranks."""
    name = _names(text, threshold)[start]
    order = np.lexsort((doc, name))
    sorted_name, sorted_doc, at = name[order], doc[order], start[order]
    begins = np.concatenate([[True], sorted_name[1:] != sorted_name[:-1]])
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    hit = sorted_doc > sorted_doc[head]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text) + 1, 8), (1, 1))
    others = np.flatnonzero(~begins)
    same = True
    for lo in range(0, len(others), 1 << 18):
        x, y = at[others[lo : lo + (1 << 18)]], at[head[others[lo : lo + (1 << 18)]]]
        for offset in [*range(0, threshold - 8, 8), threshold - 8]:
            same = same and bool((words[x + offset] == words[y + offset]).all())
    if not same:  # two strings share a 64-bit name: compare the strings themselves
        low: dict[bytes, int] = {}
        strings = [text[s : s + threshold].tobytes() for s in start.tolist()]
        for s, d in zip(strings, doc.tolist()):
            low[s] = min(low.get(s, LAST), d)
        return np.array([low[s] < d for s, d in zip(strings, doc.tolist())], bool)
    out = np.zeros(len(start), bool)
    out[order] = hit
    return out


def _repeats(groups_of, threshold: int, shift: int):
    def run(batch):
        columns = [b"".join(batch.column(i).to_pylist()) for i in range(1, 6)]
        place, count, offset, length = (np.frombuffer(c, kind) for c, kind in zip(columns, (np.int64, np.uint32, np.int64, np.int64)))
        count = count.astype(np.int64)
        text = np.frombuffer(columns[4], np.uint8)
        own = np.repeat(np.arange(len(length)), count)
        rank = place >> shift
        low = np.minimum.reduceat(rank, np.cumsum(count) - count) if len(count) else rank
        windows = length - threshold + 1
        run_of = np.repeat(np.arange(len(length)), windows)
        inner = np.arange(len(run_of)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = _earlier(text, inner + np.repeat(np.cumsum(length) - length, windows), low[run_of], threshold)
        # places after the earliest of their run are repeats throughout
        whole = rank > low[own]
        found = [(place[whole], offset[whole], offset[whole] + length[own][whole])]
        begins = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (run_of[1:] == run_of[:-1])]))
        stops = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (run_of[1:] == run_of[:-1]), [False]]))
        # the earliest places of a run have those of its strings that another run has earlier
        earliest = np.flatnonzero(~whole)
        lo, hi = np.searchsorted(run_of[begins], own[earliest]), np.searchsorted(run_of[begins], own[earliest], "right")
        which = np.repeat(earliest, hi - lo)
        span = np.arange(len(which)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        found.append((place[which], offset[which] + inner[begins][span], offset[which] + inner[stops][span] + threshold))
        doc, x, y = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        return _rows(list(_pack(groups_of(doc), doc, x, y)))

    return run


def _cut(threshold: int):
    def run(key, docs, found):
        is_copy = np.array([x is not None for x in found.column(6).to_pylist()], bool)
        copies = set(found.column(6).filter(pa.array(is_copy)).to_pylist())
        doc, a, b = _unpack(found.filter(pa.array(~is_copy)), [np.int64, np.int64])
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        out = []
        for real, d, text in zip(docs.column("doc_id").to_pylist(), docs.column("doc").to_pylist(), docs.column("text").to_pylist()):
            spans = []
            if d in copies:
                spans = [(0, len(text))] if len(text) >= threshold else []
            else:
                lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist()):
                    if y > len(text):
                        continue
                    if spans and x <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
                    else:
                        spans.append((x, y))
            kept, at = [], 0
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((real, len(text), len(text) - len(left), spans, left))
        ids, size, gone, spans, left = zip(*out) if out else [[]] * 5
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(size, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "spans": pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(left, pa.binary()),
            }
        )

    return run


def _digest(func):
    """The same cut with a digest in place of the kept bytes, so that these need not travel."""

    def run(key, docs, found):
        got = func(key, docs, found)
        return pa.table(
            {
                "doc_id": got["doc_id"],
                "n_bytes": got["n_bytes"],
                "n_removed": got["n_removed"],
                "n_spans": pa.array([len(s) for s in got["spans"].to_pylist()], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in got["kept"].to_pylist()], pa.string()),
            }
        )

    return run


def key_shift(rows: int, most: int) -> int:
    """Bits for the places of at most ``most`` rows of one id, below the position of an id's first row."""
    shift = (most - 1).bit_length()
    if (rows - 1).bit_length() + shift > KEY_BITS:
        raise ValueError(f"{rows} rows of which {most} share an id do not fit a key")
    return shift


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Cut every byte covered by a ``threshold``-byte string that also starts in a document with a smaller id.

    Returns ``(doc_id, n_bytes, n_removed, spans, kept)`` per row, with the removed byte spans and the
    kept bytes, or with ``digest`` ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``. Strings are
    judged on the input. A null text is empty. A null id counts as larger than any. Rows that repeat
    an id (or have none) each have their row, are judged apart and never remove from each other. Where
    the table's rows and those of one id take more than 63 bits together, it raises.
    """
    if threshold < max(prefix, 16):
        raise ValueError("the threshold must be at least the prefix and 16 bytes")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    shift = 0
    rows, most = base.groupBy("doc").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (most or 0) > 1:
        # keys: the position of an id's first row, then that of the row among those of its id
        shift, numbered = key_shift(rows, most), dense_index(base, "doc")
        firsts = numbered.groupBy("doc").agg(F.min("t").alias("t0"))
        key = F.shiftleft("t0", shift).bitwiseOR(F.col("t") - F.col("t0"))
        base = checkpoint(numbered.join(firsts, "doc").select("doc_id", key.alias("doc"), "text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / GROUP_BYTES))
    groups_of = _hash_group(parts)

    def group_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = groups_of(batch.column(batch.schema.get_field_index("doc")).to_numpy()).astype(np.int32)
            yield batch.append_column("g", pa.array(g))

    grouped = base.mapInArrow(group_column, "doc_id long, doc long, text binary, g int")
    anchors = base.select("doc", "text").mapInArrow(_send_anchors(parts, threshold, prefix, shift), _ROW)
    shared = anchors.groupBy("target").applyInArrow(_shared_anchors(groups_of, parts), _ROW)
    hashed = base.select("doc", F.md5("text").alias("md5")).where(F.octet_length("text") >= threshold)
    firsts = hashed.groupBy("md5").agg(F.min("doc").alias("low"), F.count("*").alias("n")).where("n > 1").select("md5", "low")
    firsts = checkpoint(firsts)  # known before the join, which may then broadcast it or split a text that many rows have
    copies = hashed.join(firsts, "md5").where(F.shiftright("doc", shift) > F.shiftright("low", shift)).select("doc").mapInArrow(group_column, "doc long, g int")
    none = [F.lit(None).cast("binary").alias(n) for n in ("ids", "counts", "a", "b", "c")]
    copy_rows = copies.select(F.col("g").alias("target"), *none, F.col("doc").alias("copy"))
    flags = shared.withColumn("copy", F.lit(None).cast("long")).unionByName(copy_rows)
    by_group = grouped.groupBy("g")
    runs = by_group.cogroup(flags.groupBy("target")).applyInArrow(_send_runs(parts, threshold, prefix), _ROW)
    repeats = runs.groupBy("target").applyInArrow(_repeats(groups_of, threshold, shift), _ROW)
    found = repeats.withColumn("copy", F.lit(None).cast("long")).unionByName(copy_rows)
    cut = _cut(threshold)
    if digest:
        return by_group.cogroup(found.groupBy("target")).applyInArrow(_digest(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return by_group.cogroup(found.groupBy("target")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
