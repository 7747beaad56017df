"""SentencePiece encoding and decoding by a table of prefixes.

Merges of this kind depend on the merged piece alone, so every prefix of a text has one encoding, and
one last token. A piece that ends at a place is that prefix's last token if it is compatible with the
last token of the shorter prefix before it: if merging the two pieces' text anew gives the two pieces.
An automaton yields the pieces that end at each place; the table keeps the one that fits, and the ids
are read from it backwards. Time is linear in the text, of whatever kind it is.

Where no piece has two letters side by side, no merge brings them together either: texts are cut between
such letters, and a slice's distinct units are encoded once, all their tables together, place after place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import map_text, table

SPACE = "▁"
#: Units, their ids, and pairs of tokens that a worker keeps before it starts that cache anew.
KEPT_UNITS, KEPT_IDS, KEPT_PAIRS = 300_000, 4_000_000, 1_000_000
#: Letters that are cut into units at once.
CHUNK = 1 << 21
#: Letters beyond which a unit's table is filled by itself.
LONG = 256


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i], ..., begin[i] + size[i] - 1 of every i in turn."""
    end = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(begin - (end - size), size)


class PieceModel:
    """Encoder and decoder of a SentencePiece BPE model that keeps white space and has byte fallback.

    A model of another kind raises: its normaliser must only write spaces as U+2581 with one in front,
    and the two encoders must agree on a few probes.
    """

    PROBES = ("", " ", "the cat", "  Straße, où?\n\t  12.5▁x ", "\U0001f600ท\u0000<s><0x0A>", "aaaaaaaaaaa", " " * 40)

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(p.id_to_piece(i), i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.rank = {piece: -p.get_score(i) for piece, i in pieces}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # kinds of letters by what stands beside them in pieces; 0: alone in any
        joined = sorted({c for piece, _ in pieces if len(piece) > 1 for c in piece})
        self.kinds, self.kind = len(joined) + 1, np.zeros(0x110000, np.int32)
        self.kind[list(map(ord, joined))] = np.arange(1, self.kinds)
        self.beside = np.zeros(self.kinds * self.kinds, bool)
        for piece, _ in pieces:
            own = self.kind[list(map(ord, piece))]
            self.beside[own[:-1] * self.kinds + own[1:]] = True
        # a piece whose own text merges into other tokens never comes out of merging
        self.tokens = [piece for piece, _ in pieces if self.merged(piece) == [piece]]
        known = {piece for piece in self.tokens if len(piece) == 1}
        self.plain = len(self.tokens)
        self.tokens += sorted({c for piece, _ in pieces for c in piece} - known)  # letters that are no piece alone, but part of one
        self.numbers = np.array([p.piece_to_id(t) for t in self.tokens] + [0], "<i4")
        self.sizes = np.array([*map(len, self.tokens), 1])  # the last one is for letters that no piece has
        self.gap = next(c for c in "\x00\ufffe\uffff" if not any(c in piece for piece, _ in pieces))
        self.automaton = ahocorasick.Automaton()
        self.letters = np.full(0x110000, -1, np.int32)  # tokens of one letter
        for at, token in enumerate(self.tokens):
            if len(token) > 1:
                self.automaton.add_word(token, at)
            else:
                self.letters[ord(token)] = at
        self.automaton.make_automaton()
        self.keys, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.clear()
        for text in self.PROBES:
            if p.normalize(text) != self.normal(text) or self.encode(text) != p.encode(text):
                raise ValueError("not a BPE model with byte fallback that keeps white space")

    def _fallback(self, letter: str) -> list[int]:
        return [self.bytes[b] for b in letter.encode()]

    def merged(self, text: str) -> list[str]:
        """The merges themselves, best piece first, leftmost of equals: for texts of one or two pieces."""
        parts = list(text)
        while True:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=np.inf)
            if best == np.inf:
                return parts
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether adjacent tokens stay as they are; known pairs are kept, sorted."""
        keys, at = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(np.append(self.keys, -1)[place] != keys)
        if len(new):
            if len(self.keys) > KEPT_PAIRS:
                self.keys, self.fits = self.keys[:0], self.fits[:0]
                return self.compatible(left, right)
            parts = [(self.tokens[k >> 32], self.tokens[k & 0xFFFFFFFF]) for k in keys[new].tolist()]
            fits = np.array([self.merged(a + b) == [a, b] for a, b in parts])
            self.keys, self.fits = np.insert(self.keys, place[new], keys[new]), np.insert(self.fits, place[new], fits)
            place = np.searchsorted(self.keys, keys)
        return self.fits[place][at]

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.ends, self.kept = np.zeros(1, np.int64), np.zeros(0, "<i4")

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids and where each unit's end: fills the tables of all of them from left to right, then reads the ids from their ends."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        if (size > LONG).any():
            ids, ends = self.encode_units([u for u in units if len(u) <= LONG])
            short = iter(np.split(ids, ends[:-1]))
            parts = [next(short) if len(u) <= LONG else self.encode_long(u) for u in units]
            return np.concatenate(parts), np.cumsum(list(map(len, parts)))
        first = np.cumsum(size + 1) - size - 1
        text = self.gap.join(units)
        single = self.letters[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        at = np.flatnonzero(single >= 0)
        end, token = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2).T
        end, token = np.concatenate([at, end]), np.concatenate([single[at], token])
        offset = end - np.repeat(first, size + 1)[end]
        before = end - self.sizes[token]
        order = np.argsort(offset.astype(np.int16 if len(offset) and offset.max() < 1 << 15 else np.int64), kind="stable")
        last = np.full(int(size.sum()) + len(units), -1)  # a letter that no piece has stays at -1: nothing merges with it
        for own in np.split(order, np.flatnonzero(np.diff(offset[order])) + 1):
            left = np.where(offset[own] >= self.sizes[token[own]], last[before[own]], -1)
            ask = left >= 0
            fits = ~ask
            fits[ask] = self.compatible(left[ask], token[own][ask])
            last[end[own][fits]] = token[own][fits]
        unit, place, tokens, rows = np.arange(len(units)), first + size - 1, [], []
        while len(unit):
            tokens.append(last[place]), rows.append(unit)
            place = place - self.sizes[last[place]]
            more = place >= first[unit]
            unit, place = unit[more], place[more]
        tokens, rows = np.concatenate([*tokens[::-1], place]), np.concatenate([*rows[::-1], unit])
        order = np.argsort(rows, kind="stable")  # the rounds are in the order of the text already
        tokens, ends = tokens[order], np.cumsum(np.bincount(rows, minlength=len(units)))
        sizes, ids = np.ones(len(tokens), np.int64), self.numbers[tokens]
        odd = np.flatnonzero((tokens < 0) | (tokens >= self.plain))
        if len(odd):  # letters that are spelt in bytes
            begin = np.cumsum(self.sizes[tokens])  # of the tokens, in the units put side by side
            letters = "".join(units)
            spelt = [self._fallback(letters[i - 1]) for i in begin[odd].tolist()]
            sizes[odd] = list(map(len, spelt))
            at = np.cumsum(sizes) - sizes
            wide = np.zeros(int(sizes.sum()), "<i4")
            wide[np.delete(at, odd)] = np.delete(ids, odd)
            wide[_spread(at[odd], sizes[odd])] = np.concatenate(spelt)
            ids = wide
        return ids, np.cumsum(sizes)[ends - 1] if len(units) else ends

    def encode_long(self, unit: str) -> np.ndarray:
        """:meth:`encode_units` of one unit of any length."""
        ending: dict[int, list[int]] = {}
        for end, token in self.automaton.iter(unit):
            ending.setdefault(end, []).append(token)
        single, size, last, known = self.letters[list(map(ord, unit))].tolist(), self.sizes.tolist(), [], {}

        def fits(left: int, right: int) -> bool:
            found = known.get((left, right))
            if found is None:
                found = known[left, right] = bool(self.compatible(np.array([left]), np.array([right]))[0])
            return found

        for end, letter in enumerate(single):
            for token in (*ending.get(end, ()), letter):
                left = last[end - size[token]] if size[token] <= end else -1
                if token < 0 or left < 0 or fits(left, token):
                    break
            last.append(token)
        tokens, end = [], len(unit) - 1
        while end >= 0:
            token = last[end]
            tokens.append(self._fallback(unit[end]) if token < 0 or token >= self.plain else [self.numbers[token]])
            end -= size[token]
        return np.array([i for ids in reversed(tokens) for i in ids], "<i4")

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _chunks(self, text: str) -> Iterator[str]:
        """A text in parts of about ``CHUNK`` letters, cut where units are."""
        at = 0
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and self.beside[self.kind[ord(text[end - 1])] * self.kinds + self.kind[ord(text[end])]]:
                end += 1
            yield text[at:end]
            at = end

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another (int32), and where each text's end."""
        found, counts, rows, parts, held = [np.zeros(0, "<i4")], np.zeros(len(texts), np.int64), [], [], 0
        for row, part in chain(((i, part) for i, text in enumerate(texts) for part in self._chunks(self.normal(text))), [(-1, "")]):
            if parts and (row < 0 or held + len(part) > CHUNK):
                ids, ends = self._encode(parts)
                found.append(ids)
                np.add.at(counts, rows, np.diff(ends, prepend=0))
                rows, parts, held = [], [], 0
            rows.append(row), parts.append(part)
            held += len(part)
        return np.concatenate(found), np.cumsum(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode_texts` of parts that are not empty, at once."""
        if len(self.units) > KEPT_UNITS or len(self.kept) > KEPT_IDS:
            self.clear()
        ends, text = np.cumsum([0, *map(len, texts)]), "".join(texts)
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kind[letters]
        cut = np.append(True, ~self.beside[kind[:-1] * self.kinds + kind[1:]])
        cut[ends[ends < len(letters)]] = True
        first = np.flatnonzero(cut)
        at_byte = np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))
        offsets = np.append(0, at_byte[np.append(first[1:], len(letters)) - 1])
        units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text.encode())).dictionary_encode()
        distinct, known = units.dictionary.to_pylist(), self.units
        new = [u for u in distinct if u not in known]
        if new:
            ids, end = self.encode_units(new)
            known |= zip(new, range(len(known), len(known) + len(new)))
            self.ends, self.kept = np.append(self.ends, end + len(self.kept)), np.append(self.kept, ids)
        row = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        size = self.ends[row + 1] - self.ends[row]
        total = np.append(0, np.cumsum(size))
        return self.kept[_spread(self.ends[row], size)], total[np.searchsorted(first, ends[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


@functools.lru_cache(1)
def model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the ids of each whole text, without begin or end; one row per input row.

    A null text counts as empty and has no ids. Ids may be null or repeat; other columns are ignored,
    an empty table gives an empty result. ``path`` must be readable on the executors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = model(path)
        ids, ends = coder.encode_texts([t or "" for t in batch.column(1).to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
        return pa.record_batch([batch.column(0), lists], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_text(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids (null: empty) as column ``name``, which must be new."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")

    def run(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(ids_col) if at is None else at
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists, coder = part.column(at), model(path)
                ids, ends = lists.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                texts = [coder.decode(own.tolist()) if len(own) else "" for own in np.split(ids, ends[:-1])]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit("")).schema)


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    path = default_model()
    rows = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
