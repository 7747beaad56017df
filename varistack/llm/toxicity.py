"""Toxicity: a counterfactual-regularised classifier of whole texts.

A text's features are its distinct words and their prefixes, hashed. A logistic model is fitted to
labelled texts, on the hashed features that tell the classes apart, with a penalty on the squared
change of the score when identity terms of a text are swapped for those of another group. Neutral
mentions of a group thus lose their pull on the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import map_text, slices, table
from varistack.llm.langid import held_out

#: Bound of the labelled sample that the model is fitted to (texts of smallest id hash first).
MAX_ROWS = 12_000
#: Features that the model keeps at most.
MAX_FEATURES = 1 << 15
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7)
L2, COUNTERFACTUAL = 0.3, 1.0
THRESHOLD = 0.3
CACHE_WORDS = 150_000

#: Identity terms by axis; a swap replaces a term by the others of its line.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)
_SWAPS = {term: tuple(t for t in line if t != term) for line in IDENTITY_TERMS for term in line}
_EDGES = ".,;:!?\"'()[]{}*%$&#|<>"


def _words(text: str) -> list[str]:
    return [s for w in set(text.lower().split()) if (s := w.strip(_EDGES))]


def _features(word: str) -> list[int]:
    from zlib import crc32

    data = word.encode("utf-8", "surrogatepass")
    full = crc32(data + b"\x03") % BUCKETS
    return [full] + [crc32(word[:n].encode("utf-8", "surrogatepass")) % BUCKETS for n in PREFIXES if len(word) >= n]


def _bag(words: list[str]) -> set[int]:
    return {f for w in set(words) for f in _features(w)}


def _fit(texts: list[str], labels: np.ndarray, l2: float, counterfactual: float, max_features: int) -> dict:
    bags, swapped = [], []
    for row, text in enumerate(texts):
        words = _words(text)
        bags.append(np.fromiter(_bag(words), np.int64))
        for term in words:
            for other in _SWAPS.get(term, ()):
                swapped.append((row, np.fromiter(_bag([other if w == term else w for w in words]), np.int64)))
    size = np.array([len(b) for b in bags])
    flat = np.concatenate(bags) if len(bags) else np.zeros(0, np.int64)
    hot = np.repeat(labels == 1, size)
    seen = np.bincount(flat, minlength=BUCKETS).astype(np.float64)
    toxic = np.bincount(flat[hot], minlength=BUCKETS).astype(np.float64)
    share = labels.mean() if len(labels) else 0.5
    z = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    strong = np.flatnonzero((seen >= 2) & (np.abs(z) > 2.5))
    strong = np.sort(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:max_features]])
    lookup = np.full(BUCKETS, -1, np.int64)
    lookup[strong] = np.arange(len(strong))

    def rows(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(own)), [len(b) for b in own])
        col = lookup[np.concatenate(own)] if own else np.zeros(0, np.int64)
        return row[col >= 0], col[col >= 0]

    row, col = rows(bags)
    pair_row, pair_col = rows([b for _, b in swapped])
    source = np.array([r for r, _ in swapped], np.int64)
    y = labels.astype(np.float64)
    w, bias = np.zeros(len(strong)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
    m, v = np.zeros(len(strong) + 1), np.zeros(len(strong) + 1)
    for step in range(1, 301):  # full-batch gradient with adaptive steps
        score = bias + np.bincount(row, w[col], len(y))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        grad = np.bincount(col, error[row], len(w)) + l2 * w
        if len(source):
            change = score[source] - bias - np.bincount(pair_row, w[pair_col], len(source))
            per_text = np.bincount(source, change, len(y))
            grad += counterfactual * (np.bincount(col, per_text[row], len(w)) - np.bincount(pair_col, change[pair_row], len(w)))
        full = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
    return {"features": strong, "weights": w, "bias": bias}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, l2: float = L2, counterfactual: float = COUNTERFACTUAL, max_features: int = MAX_FEATURES) -> dict:
    """Fit on at most ``max_rows`` labelled texts, in one task of that bounded size.

    Null texts count as empty, null labels or ids are left out. Without labelled rows the model
    scores every text at 0.5 times nothing, that is 0.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ids that repeat must not lift the bound; which of their rows are taken does not hang on the partitions
    sample = texts.join(F.broadcast(chosen), "id").select("text", "y").orderBy(F.xxhash64("text"), "y").limit(2 * max_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got_texts, got_labels = [], []
        for batch in slices(batches):
            got_texts += batch.column(0).to_pylist()
            got_labels += batch.column(1).to_pylist()
        if got_texts:
            order = sorted(range(len(got_texts)), key=lambda i: (got_texts[i], got_labels[i]))
            model = _fit([got_texts[i] for i in order], np.array([got_labels[i] for i in order]), l2, counterfactual, max_features)
            yield pa.record_batch([pa.array([model["features"].tolist()]), pa.array([model["weights"].tolist()]), pa.array([model["bias"]])], names=["features", "weights", "bias"])

    row = sample.coalesce(1).mapInArrow(fit, "features array<long>, weights array<double>, bias double").first()
    if row is None:
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    return {"features": np.array(row["features"], np.int64), "weights": np.array(row["weights"], np.float64), "bias": row["bias"]}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` per row, the model's probability of a toxic text.

    A null text is empty; an empty one has the score of the bias alone. Repeated and null ids are kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features numbers
    cache: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "weights" not in cache:
            table_ = np.zeros(BUCKETS, np.float32)
            table_[shared.value["features"]] = shared.value["weights"]
            cache["weights"], cache["words"] = table_, {}
        weights, known = cache["weights"], cache["words"]
        if len(known) > CACHE_WORDS:
            known.clear()
        active = set(shared.value["features"].tolist()) if "active" not in cache else cache["active"]
        cache["active"] = active
        out = []
        for text in batch.column(1).to_pylist():
            bag: set[int] = set()
            for word in set(text.lower().split()) if text else ():
                own = known.get(word)
                if own is None:
                    stem = word.strip(_EDGES)
                    own = known[word] = tuple(f for f in _features(stem) if f in active) if stem else ()
                if own:
                    bag.update(own)
            out.append(shared.value["bias"] + sum(float(weights[f]) for f in sorted(bag)))
        prob = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
        return pa.record_batch([batch.column(0), pa.array(prob)], names=["id", "score"])

    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
