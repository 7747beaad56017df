"""Language identification of mixed-language text.

Training counts hashed character n-grams of words per language, over about ``DOCS_PER_LANG`` labelled
documents of each. A word's score per language is the mean log-likelihood of its n-grams. To label a
text, the Unicode script ranges of a word's letters narrow the candidates to the languages seen with
that script in training; Viterbi then finds the sequence of languages, one per word, of the largest
summed score, less a penalty for every switch. The language of most letters is the text's.

A word is what stands between white space. One of several scripts, or a sentence of a script that sets
no spaces, is one word and goes by the script of its first letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import map_text, slices, table

#: Bound of the labelled sample: expected training documents per language (all, where there are fewer).
DOCS_PER_LANG = 1500
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
SWITCH_PENALTY = 6.0
#: Share of a text's letters that its language must have for the text to be kept.
MIN_SHARE = 0.3
#: Distinct words whose scores a task keeps before it starts its cache anew.
CACHE_WORDS = 100_000

#: First code point of each script range, and the script; a range ends where the next begins.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0750, 0x0780, 0x0900, 0x0980, 0x0A00, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xAC00, 0xD7B0)
SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Arabic", "Other", "Devanagari", "Bengali", "Indic", "Tamil", "Telugu", "Thai", "Lao", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "Other", "Hiragana", "Katakana", "Other", "Han", "Hangul", "Other")


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class _Grams:
    """Hashed character n-grams of many words at once; words are marked at both ends."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.begin = np.cumsum(self.size) - self.size
        joined = "".join([f"\x02{w}\x03" for w in words])
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def hashed(self, n: int) -> np.ndarray:
        """Bucket of the n-gram at every position (those that cross a word's end mean nothing)."""
        padded = np.concatenate([self.code, np.zeros(n, np.uint64)])
        h = np.full(len(self.code), n, np.uint64)
        for j in range(n):
            h = (h ^ padded[j : j + len(self.code)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(BUCKETS)).astype(np.int64)

    def counts(self, n: int) -> np.ndarray:
        return np.maximum(self.size - n + 1, 0)

    def scripts(self) -> np.ndarray:
        """Index into ``SCRIPT_NAMES`` of each word's first letter."""
        return np.searchsorted(SCRIPT_STARTS, self.code[self.begin + 1], "right") - 1


def _words(text: str) -> list[str]:
    return text.lower().split()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> dict:
    """A model from labelled texts: ``{"langs": [...], "logp": [bucket, lang] float32, "scripts": {script: [lang index]}}``.

    Rows with a null text or language are left out. The sample holds the documents whose text hashes
    under a rate per language, so about ``docs_per_lang`` each; gram counts are summed on the executors,
    and the model's size is fixed by the number of languages. Without labelled rows it has no languages.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((BUCKETS, 0), np.float32), "scripts": {}}
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / sizes[lang]))).otherwise(rate)
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < rate * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in slices(batches):
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in _words(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            for lang in {x for x, _ in seen}:
                stems: dict[str, int] = {}
                for (own, word), n in seen.items():
                    if own == lang and (letters := _letters(word)):
                        stems[letters] = stems.get(letters, 0) + n
                if not stems:
                    continue
                words, number = _Grams(list(stems)), np.fromiter(stems.values(), np.int64, len(stems))
                counts = grams.setdefault(lang, np.zeros(BUCKETS, np.int64))
                inside = np.arange(len(words.code)) - np.repeat(words.begin, words.size)
                for n in NGRAMS:
                    weight = np.repeat(number, words.size) * (inside <= np.repeat(words.size - n, words.size))
                    counts += np.bincount(words.hashed(n), weight, BUCKETS).astype(np.int64)
                for script, n in zip(words.scripts().tolist(), number.tolist()):
                    pair = lang, SCRIPT_NAMES[script]
                    scripts[pair] = scripts.get(pair, 0) + n
        for lang, counts in grams.items():
            at = np.flatnonzero(counts)
            own = [(s, n) for (g, s), n in scripts.items() if g == lang]
            keys = [str(x) for x in at.tolist()] + [s for s, _ in own]
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts[at].tolist() + [n for _, n in own], pa.int64())], names=["lang", "key", "n"])

    counted = sample.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts, scripts = np.full((BUCKETS, len(langs)), 0.5), {}
    for row in counted.collect():  # at most buckets + scripts per language
        if row["key"].isdigit():
            counts[int(row["key"]), langs.index(row["lang"])] += row["n"]
        else:
            scripts.setdefault(row["key"], {})[langs.index(row["lang"])] = row["n"]
    logp = np.log(counts) - np.log(counts.sum(0))
    totals = {i: sum(by.get(i, 0) for by in scripts.values()) for i in range(len(langs))}
    narrow = {s: sorted(i for i, n in by.items() if n >= 0.01 * totals[i]) for s, by in scripts.items()}
    return {"langs": langs, "logp": logp.astype(np.float32), "scripts": narrow}


class Labeller:
    """Labels words of texts with languages under a trained model."""

    def __init__(self, model: dict, switch_penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, switch_penalty
        self._clear()

    def _clear(self):
        """Row 0 is that of words without a letter."""
        self.known: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.score = np.zeros((1, len(self.model["langs"])), np.float32)
        self.size = np.zeros(1, np.int64)
        self.foreign = np.zeros(1, bool)  # first letter in a script that no language was seen with

    def _learn(self, words: list[str]) -> None:
        stems = [_letters(w) for w in words]
        new = list(dict.fromkeys(x for x in stems if x and x not in self.stems))
        if new:
            self.stems.update(zip(new, range(len(self.score), len(self.score) + len(new))))
            self.score = np.concatenate([self.score, self._scores(new)])
            names = [SCRIPT_NAMES[i] for i in _Grams(new).scripts()]
            self.foreign = np.concatenate([self.foreign, [not self.model["scripts"].get(n) for n in names]])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        self.known.update((w, self.stems[x] if x else 0) for w, x in zip(words, stems))

    def _scores(self, words: list[str]) -> np.ndarray:
        grams, logp = _Grams(words), self.model["logp"]
        total, number = np.zeros((len(words), logp.shape[1])), np.zeros(len(words))
        for n in NGRAMS:
            sums = np.concatenate([np.zeros((1, logp.shape[1])), np.cumsum(logp[grams.hashed(n)], axis=0, dtype=np.float64)])
            many = grams.counts(n)
            total += sums[grams.begin + many] - sums[grams.begin]
            number += many
        # a mean over n-grams, weighted up to the word's length so that longer words count for more
        each = (total / number[:, None] * np.minimum(grams.size - 2, 8)[:, None]).astype(np.float32)
        script = grams.scripts()
        for own in np.unique(script):
            among = self.model["scripts"].get(SCRIPT_NAMES[own])
            if among and len(among) < each.shape[1]:
                rows = np.flatnonzero(script == own)
                others = [i for i in range(each.shape[1]) if i not in among]
                each[np.ix_(rows, others)] = each[rows].min(1, keepdims=True) - 20
        return each

    def label(self, texts: list[str | None], known_scripts: bool = False) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
        """Words, their letters' number and their language's index, per text.

        With ``known_scripts`` letters of words in a script without a language count below nought.
        """
        words = [_words(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self._clear()
        new = list({w for own in words for w in own}.difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        at = [np.fromiter(map(get, own), np.int64, len(own)) for own in words]
        size = np.where(self.foreign, -self.size, self.size) if known_scripts else self.size
        return words, [size[x] for x in at], self._viterbi(at)

    def _viterbi(self, at: list[np.ndarray]) -> list[np.ndarray]:
        """All texts step together, the longest first, so that those that have ended drop off."""
        order = sorted(range(len(at)), key=lambda i: -len(at[i]))
        size = np.array([len(at[i]) for i in order], np.int64)
        steps, langs = int(size[0]) if len(size) else 0, len(self.model["langs"])
        live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # texts with more than t words
        base = np.concatenate([[0], np.cumsum(live)])
        flat = np.zeros(int(base[-1]), np.int64)
        for rank, i in enumerate(order):
            flat[base[: size[rank]] + rank] = at[i]
        number = np.min_scalar_type(-max(langs, 1))  # signed, as small as holds every language
        back = np.zeros((len(flat), langs), number)
        best = np.zeros((len(order), langs), np.float32)
        own = np.arange(langs)
        for t in range(steps):
            n = live[t]
            v = best[:n]
            top = v.argmax(1)
            high = v[np.arange(n), top][:, None] - self.penalty
            stay = v >= high
            back[base[t] : base[t + 1]] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, v, high) + self.score[flat[base[t] : base[t + 1]]]
        out = np.zeros(len(flat), number)
        state = best.argmax(1).astype(np.int64) if langs else np.zeros(len(order), np.int64)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            out[base[t] : base[t + 1]] = state[:n]
            state[:n] = back[base[t] : base[t + 1]][np.arange(n), state[:n]]
        labels: list[np.ndarray] = [np.zeros(0, number)] * len(at)
        for rank, i in enumerate(order):
            labels[i] = out[base[: size[rank]] + rank]
        return labels


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", switch_penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """``(id_col, lang_pred, score[, spans])`` per row; spans are ``(first word, words, lang)`` in text order.

    lang_pred is the language of most letters (ties: the first by name), score its share of the letters.
    A null text, one without a letter, or an empty model gives ``und`` with score 0 and no spans. Every
    row is kept, with null and repeated ids too.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    langs = model["langs"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the languages
    cache: dict[str, Labeller] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labeller = cache.setdefault("it", Labeller(shared.value, switch_penalty))
        texts = batch.column(1).to_pylist()
        pred, score, spans = [], [], []
        if not langs:
            texts = [None] * len(texts)
        _, sizes, labels = labeller.label(texts) if langs else ([], [np.zeros(0)] * len(texts), [np.zeros(0, np.int8)] * len(texts))
        for size, label in zip(sizes, labels):
            total = size.sum()
            if not total:
                pred.append("und"), score.append(0.0), spans.append([])
                continue
            share = np.bincount(label, size, len(langs))
            pred.append(langs[int(share.argmax())]), score.append(float(share.max() / total))
            if with_spans:
                cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
                spans.append([{"first": int(a), "words": int(b - a), "lang": langs[label[a]]} for a, b in zip(cut, [*cut[1:], len(label)])])
        columns, names = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"]
        if with_spans:
            columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            names.append("spans")
        return pa.record_batch(columns, names=names)

    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<first:long,words:long,lang:string>>" * with_spans
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", min_share: float = MIN_SHARE, switch_penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows, whole, in whose text some language has at least ``min_share`` of the letters.

    Texts without a letter, null texts, texts in which no language prevails, and texts mostly in scripts
    that no language was learned with go. An empty model keeps nothing.
    """
    langs = len(model["langs"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, Labeller] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            labeller = cache.setdefault("it", Labeller(shared.value, switch_penalty))
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            _, sizes, labels = labeller.label(texts, known_scripts=True) if langs else ([], [np.zeros(0)] * len(texts), [np.zeros(0, np.int8)] * len(texts))
            keep = [bool(total := np.abs(size).sum()) and np.bincount(label, np.maximum(size, 0), langs).max() >= min_share * total for size, label in zip(sizes, labels)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs, model, with_spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
