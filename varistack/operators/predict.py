"""Predictions of single rows from fitted folds, their stack, and scores by any mergeable function.

Weights go to the rows: a pass broadcasts the weights of some targets, of all spaces and the stack,
in at most ``PASS_BYTES``, and every task predicts, sums up over the spaces and scores in place. No row
is exploded, joined or shuffled for it; scores send a state per task and target.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.functions.scores import R2
from varistack.operators.moments import _matrix, last_bounds
from varistack.operators.stack import Fitted, _labels, space_columns, weighted
from varistack.sources.tables import shared_folder

#: Bytes of weights in one pass; one target's, if it has more.
PASS_BYTES = 256 << 20
_CELLS = "outer_fold int, space int, start int, weights binary, frames binary, targets binary"
_STATES = "role string, outer_fold int, space_id int, start int, state binary"
_SCORED = "role string, outer_fold int, space_id int, start int, score array<double>"


def _cut(width: int, dims: list[int], inner: int, target_block: int, train: bool) -> Callable:
    """Fits cut to ``width`` targets, with the weights that predictions of train or test rows need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s, b, w, frames, targets in zip(*(c.to_pylist() for c in batch.columns)):
                w, y = np.frombuffer(w).reshape(inner + 1, dims[s], -1), np.frombuffer(targets).reshape(2, 2, -1)
                w = w[:inner] if train else w[inner:]
                for at in range(0, w.shape[2], width):
                    rows = [k, s, b * target_block + at, w[:, :, at : at + width].tobytes(), frames, y[:, :, at : at + width].tobytes()]
                    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(rows, kinds)], names=[x.split()[0] for x in _CELLS.split(", ")])

    return run


class _Cell:
    """Weights of an outer fold for some targets, of all spaces, and of the stack (target, space)."""

    def __init__(self, fitted_dims: list[int], k: int, start: int, parts: dict, stack: np.ndarray, train: bool):
        self.k, self.start, self.stack, self.train = k, start, stack, train
        self.weights = [np.frombuffer(w).reshape(-1, d, len(stack)) for d, (w, _, _) in zip(fitted_dims, parts)]
        self.frames = [np.frombuffer(f).reshape(-1, 2, d) for d, (_, f, _) in zip(fitted_dims, parts)]
        self.targets = np.frombuffer(parts[0][2]).reshape(2, 2, -1)[0 if train else 1]

    def predicted(self, t: np.ndarray, z: np.ndarray, spaces: list[np.ndarray], fold: tuple[int, int], n: int, inner: int):
        """``(rows, predictions of each space, real)`` of the rows that this cell predicts."""
        lo, hi = fold
        inside = (t >= lo) & (t < hi)
        at = np.flatnonzero(~inside if self.train else inside)
        if not len(at):
            return at, [], None
        if self.train:
            which = _labels(np.where(t[at] < lo, t[at], t[at] - (hi - lo)), last_bounds(n - (hi - lo), inner))
        else:
            which = np.zeros(len(at), np.int64)
        out = []
        for own, w, frames in zip(spaces, self.weights, self.frames):
            frame = which if self.train else np.full(len(at), inner)
            x = np.nan_to_num((z[at][:, own] - frames[frame, 0]) * frames[frame, 1])
            pred = np.zeros((len(at), w.shape[2]))
            for g in np.unique(which):
                pred[which == g] = x[which == g] @ w[g]
            out.append(pred)
        first = sum(map(len, spaces)) + self.start
        mean, inverse = self.targets
        return at, out, np.nan_to_num((z[at][:, first : first + len(mean)] - mean) * inverse)


def _passes(fitted: Fitted, train: bool, schema: str, make: Callable) -> DataFrame:
    """``make(cells, batches of (t, z))`` over the design, pass after pass."""
    spark, dims, f = fitted.design.sparkSession, fitted.dims, len(fitted.dims)
    per_target = 8 * (sum(dims) * (fitted.inner if train else 1) + f)
    width = int(np.clip(PASS_BYTES // per_target, 1, fitted.target_block))
    v = fitted.stats.agg(F.max("target_id")).first()[0] + 1
    starts = [a for b in range(0, v, fitted.target_block) for a in range(b, min(b + fitted.target_block, v), width)]
    cells = [(k, start) for k in range(len(fitted.folds)) for start in starts]
    each = max(1, PASS_BYTES // (per_target * width))
    passes = [cells[i : i + each] for i in range(0, len(cells), each)]
    models = fitted.fits.select("outer_fold", "space", "block", "weights", "frames", "targets").mapInArrow(_cut(width, dims, fitted.inner, fitted.target_block, train), _CELLS)
    if len(passes) > 1:  # so that a pass reads its own cells only
        folder = f"{shared_folder(spark)}/weights-{uuid.uuid4().hex}"
        models.write.partitionBy("outer_fold", "start").parquet(folder)
        models = spark.read.parquet(folder)
    stacks = weighted(fitted.stats, f).select("outer_fold", "target_id", "w")
    spaces, folds, n, inner, out = space_columns(dims), fitted.folds, fitted.n, fitted.inner, []
    for own in passes:
        low, high = min(s for _, s in own), max(s for _, s in own) + width
        keys = sorted({k for k, _ in own})
        rows = models.where(F.col("outer_fold").isin(keys) & (F.col("start") >= low) & (F.col("start") < high)).select("outer_fold", "start", "space", "weights", "frames", "targets").collect()
        parts: dict = {}
        for k, start, s, *data in map(tuple, rows):
            parts.setdefault((k, start), {})[s] = tuple(map(bytes, data))
        w = {(r[0], r[1]): r[2] for r in stacks.where(F.col("outer_fold").isin(keys) & (F.col("target_id") >= low) & (F.col("target_id") < high)).collect()}
        sent = [(k, s, [parts[k, s][i] for i in range(f)], np.array([w[k, t] for t in range(s, min(s + width, v, (s // fitted.target_block + 1) * fitted.target_block))])) for k, s in own]
        shared = spark.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            models = [_Cell(dims, *cell, train) for cell in shared.value]
            read = ((batch.column(0).to_numpy(), _matrix(batch)) for batch in batches if batch.num_rows)
            yield from make(models, ((cell, t, *cell.predicted(t, z, spaces, folds[cell.k], n, inner)) for t, z in read for cell in models))

        out.append(fitted.design.select("t", "x", "y").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, out)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def predictions(fitted: Fitted, train: bool = False) -> DataFrame:
    """``(t, outer_fold, space_id, start, pred, real)`` per row and space, with an entry per target from ``start`` on.

    Test rows by the final weights, ``real`` in the frame that scores use; or with ``train`` the train rows
    of every outer fold by the weights of the inner fold that leaves them out, ``real`` in the train frame:
    ``real - pred`` is the error.
    """

    def make(cells, found):
        for cell, t, at, preds, real in found:
            for s, pred in enumerate(preds):
                same = [pa.array([x] * len(at), pa.int32()) for x in (cell.k, s, cell.start)]
                yield pa.record_batch([pa.array(t[at]), *same, _lists(pred), _lists(real)], names=["t", "outer_fold", "space_id", "start", "pred", "real"])

    return _passes(fitted, train, "t long, outer_fold int, space_id int, start int, pred array<double>, real array<double>", make)


def long_predictions(fitted: Fitted, train: bool = False) -> DataFrame:
    """:func:`predictions` with a row per target: ``(t, outer_fold, space_id, target_id, pred, real)``."""
    rows = predictions(fitted, train).select("t", "outer_fold", "space_id", "start", F.posexplode(F.arrays_zip("pred", "real")).alias("pos", "v"))
    return rows.select("t", "outer_fold", "space_id", (F.col("start") + F.col("pos")).alias("target_id"), "v.pred", "v.real")


def stacked_predictions(fitted: Fitted, train: bool = False) -> DataFrame:
    """``(t, outer_fold, target_id, pred, real)``: the spaces' predictions summed by the stack weights, in the tasks that make them."""

    def make(cells, found):
        for cell, t, at, preds, real in found:
            if preds:
                pred = sum(p * cell.stack[:, s] for s, p in enumerate(preds))
                same = [pa.array([x] * len(at), pa.int32()) for x in (cell.k, cell.start)]
                yield pa.record_batch([pa.array(t[at]), *same, _lists(pred), _lists(real)], names=["t", "outer_fold", "start", "pred", "real"])

    rows = _passes(fitted, train, "t long, outer_fold int, start int, pred array<double>, real array<double>", make)
    rows = rows.select("t", "outer_fold", "start", F.posexplode(F.arrays_zip("pred", "real")).alias("pos", "v"))
    return rows.select("t", "outer_fold", (F.col("start") + F.col("pos")).alias("target_id"), "v.pred", "v.real")


def scored(fitted: Fitted, score=R2()) -> DataFrame:
    """``(target_id, space_id, score, score_weighted, score_train)`` by a mergeable score; the stack has a null space.

    Test scores are over all test rows, train scores the mean over the outer folds of those of the
    out-of-fold predictions. A weighted score is that of a space's predictions times its stack weight.
    """
    f = len(fitted.dims)

    def states(role: str):
        def make(cells, found):
            held = {}
            for cell, _, _, preds, real in found:
                if not preds:
                    continue
                fold = cell.k if role == "train" else -1
                made = [(role, s, p) for s, p in enumerate(preds)] + [(role, -1, sum(p * cell.stack[:, s] for s, p in enumerate(preds)))]
                if role == "test":
                    made += [("weighted", s, p * cell.stack[:, s]) for s, p in enumerate(preds)]
                for kind, s, pred in made:
                    key = kind, fold, s, cell.start
                    held[key] = score.update(held[key] if key in held else score.init(real.shape[1]), pred, real)
            for (kind, fold, s, start), state in held.items():
                columns = [pa.array([kind]), *(pa.array([x], pa.int32()) for x in (fold, s, start)), pa.array([np.asarray(state, np.float64).tobytes()], pa.binary())]
                yield pa.record_batch(columns, names=["role", "outer_fold", "space_id", "start", "state"])

        return make

    rows = len(score.init(1))

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for data in (d for batch in batches for d in batch.column(batch.schema.get_field_index("state")).to_pylist()):
            own = np.frombuffer(data).reshape(rows, -1)
            total = own if total is None else score.merge(total, own)
        columns = [pa.array([key[0].as_py()]), *(pa.array([k.as_py()], pa.int32()) for k in key[1:])]
        yield pa.record_batch([*columns, _lists(np.asarray(score.finish(total), np.float64)[None])], names=["role", "outer_fold", "space_id", "start", "score"])

    both = _passes(fitted, False, _STATES, states("test")).unionByName(_passes(fitted, True, _STATES, states("train")))
    merged = both.groupBy("role", "outer_fold", "space_id", "start").applyInArrow(merge, _SCORED)
    long = merged.select("role", "space_id", "start", F.posexplode("score").alias("pos", "value"))
    of = lambda role: F.when(F.col("role") == role, F.col("value"))
    found = long.groupBy((F.col("start") + F.col("pos")).alias("target_id"), "space_id").agg(F.max(of("test")).alias("score"), F.max(of("weighted")).alias("score_weighted"), F.avg(of("train")).alias("score_train"))
    stack = F.col("space_id") == -1
    return found.select("target_id", F.when(~stack, F.col("space_id")).alias("space_id"), "score", F.when(stack, F.col("score")).otherwise(F.col("score_weighted")).alias("score_weighted"), "score_train")
