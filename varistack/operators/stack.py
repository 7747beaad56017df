"""Stacked regression over named groups of predictors, cross-validated, from one pass of moments.

``fit_folds`` fits each (outer fold, space, block of targets) once, and keeps the weights and a small row
per (outer fold, target): error cross moments P for the stack weights, and the
test side's moments of the predictions. All scores, of all spaces or any subset of them, follow from
those rows without another fit; predictions of single rows follow from the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistack.functions.expressions import r2_of
from varistack.operators import tsqr
from varistack.operators.moments import Moments, Side, _array, column_means, first_bounds, from_rows, last_bounds, segment_moments, segment_starts, target_blocks
from varistack.operators.qp import simplex_udf, simplex_weights
from varistack.operators.ridge import LAMBDAS, checked_solver, fit, lambda_costs, raw_costs, solve, solve_raw
from varistack.sources.tables import checkpointed

INNER_FOLDS, SPLITS = 5, 5
TARGET_BLOCK = 4096
#: Tasks that share the target blocks of an outer fold and space: each gets the predictors' moments once.
LANES = 8
#: Bytes of moments up to which a task fits all spaces of an outer fold.
FOLD_BYTES = 64 << 20
METHODS = ("cross_val_ridge", "simple_ridge")
STATS = "outer_fold int, target_id int, n long, base double, alive boolean, train_alive boolean, p array<double>, c array<double>, q array<double>"
#: A fitted (outer fold, space, target block): ``weights`` are (inner folds then final, column, target), ``frames``
#: (inner folds then test, mean then 1 / sd, column), ``targets`` (train then score frame, mean then 1 / sd, target).
FITS = "outer_fold int, space int, block int, n long, penalty array<double>, weights binary, frames binary, targets binary, stats array<struct<base:double,cross:double,own:double,held:double,c:double,q:double,alive:boolean,train_alive:boolean>>"
_PAIRS = "outer_fold int, i int, j int, block int, stats array<struct<own:double,q:double>>"


def _labels(position: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds[:-1], position, "right") - 1


def _inverse(sd: np.ndarray) -> np.ndarray:
    return np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)


class Fold:
    """The segments of one outer fold [a, b): train and test side, inner folds, splits of the penalty search."""

    def __init__(self, starts: np.ndarray, a: int, b: int, n: int, inner: int, splits: int):
        self.test = (starts >= a) & (starts < b)
        self.train, self.size = ~self.test, n - (b - a)
        position = np.where(starts < a, starts, starts - (b - a))
        self.split = _labels(position, first_bounds(self.size, splits))
        bounds = last_bounds(self.size, inner)
        block = _labels(position, bounds)
        self.inner = []
        for k, (c, d) in enumerate(zip(bounds[:-1], bounds[1:])):
            within = np.where(position < c, position, position - (d - c))
            self.inner.append((self.train & (block != k), self.train & (block == k), _labels(within, first_bounds(self.size - (d - c), splits))))


def fit_space(m: Moments, fold: Fold, own: np.ndarray, method: str, splits: int, frame: str, penalties: np.ndarray = LAMBDAS, origin: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights of a space in every inner fold and on the whole train side, and what their scores need."""
    outer, held = m.select(fold.train), m.select(fold.test)
    score = m.select(np.ones_like(fold.train)) if frame == "global" else held
    dead_x, dead_y = ~outer.alive[..., : m.p], ~outer.y_alive
    fixed = solve(outer, own, np.array([100.0]))[0] * ~dead_y[..., None, :] if method == "simple_ridge" else None
    inverse = np.where(dead_y, 0.0, _inverse(outer.y_sd))
    base, cross, both = np.zeros((3, *dead_y.shape))
    weights, frames = [], []
    for train, val_mask, split in fold.inner:
        side, val = m.select(train), m.select(val_mask)
        w = fit(m, train, split, splits, own, dead_x | ~side.alive[..., : m.p], dead_y | ~side.y_alive, penalties)[0] if fixed is None else fixed
        base += val.n * (val.y_sd**2 + (val.y_mean - outer.y_mean) ** 2) * inverse**2
        cross += val.n * val.y_sd * inverse * (w * val.rxy[..., own, :]).sum(-2)
        both += _both(val, own, own, w, w)
        weights.append(w), frames.append((val.mean[..., own], _inverse(val.sd[..., own])))
    w, penalty = fit(m, fold.train, fold.split, splits, own, dead_x, dead_y, penalties)
    weights.append(w), frames.append((held.mean[..., own], _inverse(held.sd[..., own])))
    unit = _inverse(score.y_sd)
    shift = np.zeros(held.mean.shape[-1]) if origin is None else origin
    frames = np.array(frames)
    frames[:, 0] += shift[own]
    return {
        "n": held.n, "penalty": penalty, "weights": np.stack(weights), "frames": frames,
        "targets": np.stack([[outer.y_mean + shift[m.p :], inverse], [score.y_mean + shift[m.p :], unit]]),
        "base": base / fold.size, "cross": cross / fold.size, "own": both / fold.size,
        "held": held.n * (held.y_sd**2 + (held.y_mean - score.y_mean) ** 2) * unit**2,
        "c": held.n * held.y_sd * unit * (w * held.rxy[..., own, :]).sum(-2), "q": _both(held, own, own, w, w),
        "alive": score.y_alive, "train_alive": ~dead_y,
    }


def _both(side: Side, i: np.ndarray, j: np.ndarray, wi: np.ndarray, wj: np.ndarray) -> np.ndarray:
    """Sums over a side's rows of products of two spaces' predictions, per target."""
    return side.n * (wi * (side.rxx[..., i[:, None], j] @ wj)).sum(-2)


def fit_pair(m: Moments, fold: Fold, i: np.ndarray, j: np.ndarray, wi: np.ndarray, wj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of two spaces' predictions: the mean over the train side's validation folds, the sum over the test side."""
    own = sum(_both(m.select(val), i, j, a, b) for (_, val, _), a, b in zip(fold.inner, wi, wj))
    return own / fold.size, _both(m.select(fold.test), i, j, wi[-1], wj[-1])


def fold_matrices(m: Moments, fold: Fold, spaces: list[np.ndarray], method: str, splits: int, frame: str):
    """``(n, base, alive, train_alive, P, c, Q)`` of a fold whose moments one task holds."""
    fits = [fit_space(m, fold, own, method, splits, frame) for own in spaces]
    first, f = fits[0], len(fits)
    p, q = np.zeros((2, *first["base"].shape, f, f))
    for i, a in enumerate(fits):
        for j in range(i, f):
            b = fits[j]
            own, both = (a["own"], a["q"]) if i == j else fit_pair(m, fold, spaces[i], spaces[j], a["weights"], b["weights"])
            p[..., i, j] = p[..., j, i] = first["base"] - a["cross"] - b["cross"] + own
            q[..., i, j] = q[..., j, i] = both
    return first["n"], first["held"], first["alive"], first["train_alive"], p, np.stack([x["c"] for x in fits], axis=-1), q


def space_columns(dims: Sequence[int]) -> list[np.ndarray]:
    ends = np.cumsum(dims)
    return [np.arange(e - d, e) for e, d in zip(ends, dims)]


def pack(df: DataFrame, t: str | Column, spaces: Sequence[Sequence[Column] | Column], targets: Sequence[Column] | Column) -> DataFrame:
    """``(t, x, y)`` from scalar or array columns of each space and the targets; nulls become NaN."""

    def one(part) -> Column:
        arr = F.array(*part) if isinstance(part, (list, tuple)) else part
        return F.transform(arr.cast("array<double>"), lambda e: F.coalesce(e, F.lit(float("nan"))))

    x = F.concat(*[one(s) for s in spaces])
    return df.select((F.col(t) if isinstance(t, str) else t).cast("long").alias("t"), x.alias("x"), one(targets).alias("y"))


@dataclass
class Fitted:
    """Fits of all outer folds: ``fits`` has rows of ``FITS``, ``stats`` of ``STATS``; both are checkpointed,
    so that every score, subset and chain step reads them."""

    design: DataFrame
    dims: list[int]
    folds: list[tuple[int, int]]
    n: int
    inner: int
    target_block: int
    fits: DataFrame
    stats: DataFrame


def checked_size(design: DataFrame) -> int:
    """The number of rows, whose ``t`` must be dense and 0-based."""
    n, top = design.agg(F.count("*"), F.max("t")).first()
    if not n or top != n - 1:
        raise ValueError("t must be dense and 0-based")
    return n


def checked_penalties(penalties: Sequence[float] | None) -> np.ndarray:
    grid = LAMBDAS if penalties is None else np.asarray(penalties, np.float64)
    if grid.ndim != 1 or not len(grid) or not (grid >= 0).all():
        raise ValueError("penalties must be a list of numbers from 0 up")
    return grid


def _fit_row(k: int, i: int, b: int, got: dict) -> pa.Table:
    """A row of ``FITS``."""
    names = [x.split(":")[0] for x in FITS.split("struct<")[1].rstrip(">").split(",")]
    stats = pa.StructArray.from_arrays([pa.array(got[x]) for x in names], names)
    columns = [pa.array([x], pa.int32()) for x in (k, i, b)] + [pa.array([got["n"]], pa.int64()), pa.array([got["penalty"].tolist()], pa.list_(pa.float64()))]
    columns += [pa.array([got[x].astype(np.float64).tobytes()], pa.binary()) for x in ("weights", "frames", "targets")]
    return pa.table([*columns, pa.ListArray.from_arrays(pa.array([0, len(stats)], pa.int32()), stats)], names=["outer_fold", "space", "block", "n", "penalty", "weights", "frames", "targets", "stats"])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _fill(m: Moments, rows: Iterator[tuple]) -> None:
    """Take in a space's rows (their last columns are segment, kind and data), or a target block's beside it."""
    p = m.p
    for *_, seg, kind, data in rows:
        values = np.frombuffer(data)
        if kind in ("sx", "sy"):
            at = slice(0, p) if kind == "sx" else slice(p, None)
            n, m.s[seg, at], square, m.low[seg, at], m.high[seg, at] = values.reshape(5, -1)
            m.n[seg] = n[0]
            if kind == "sy":
                m.yy[seg] = square
        else:
            part = getattr(m, kind)[seg]
            part[:] = values.reshape(part.shape)


def _whole_folds(moments: DataFrame, starts: np.ndarray, folds: list, n: int, origin: np.ndarray, spaces: list[np.ndarray], v: int, inner: int, splits: int, method: str, frame: str, grid: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """Fits and pairs of outer folds whose moments one task holds: a task has a fold."""
    columns = dict(enumerate(spaces))

    def run(key, batch):
        k = key[0].as_py()
        m, fold = from_rows(batch, len(starts), columns, v), Fold(starts, *folds[k], n, inner, splits)
        fits, rows = [fit_space(m, fold, own, method, splits, frame, grid, origin) for own in spaces], []
        for i, got in enumerate(fits):
            both = [(j, *fit_pair(m, fold, spaces[i], spaces[j], got["weights"], fits[j]["weights"])) for j in range(i + 1, len(spaces))]
            pairs = [{"j": j, "stats": [{"own": a, "q": b} for a, b in zip(own.tolist(), q.tolist())]} for j, own, q in both]
            kind = pa.list_(pa.struct([("j", pa.int32()), ("stats", pa.list_(pa.struct([("own", pa.float64()), ("q", pa.float64())])))]))
            rows.append(_fit_row(k, i, 0, got).append_column("pairs", pa.array([pairs], kind)))
        return pa.concat_tables(rows)

    tasks = moments.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in range(len(folds))])))
    both = checkpointed(tasks.groupBy("outer_fold").applyInArrow(run, FITS + ", pairs array<struct<j:int,stats:array<struct<own:double,q:double>>>>"))
    pairs = both.select("outer_fold", F.col("space").alias("i"), "block", F.explode("pairs").alias("pair")).select("outer_fold", "i", F.col("pair.j").alias("j"), "block", "pair.stats")
    return both.drop("pairs"), pairs if len(spaces) > 1 else None


def fit_folds(design: DataFrame, dims: Sequence[int], n_folds: int = 4, method: str = "cross_val_ridge", train_end: int | None = None, inner: int = INNER_FOLDS, splits: int = SPLITS, target_block: int = TARGET_BLOCK, penalties: Sequence[float] | None = None, solver: str = "plain") -> Fitted:
    """Fit every (outer fold, space) once. ``design`` has dense 0-based ``t``, and arrays ``x``, ``y``.

    With ``train_end`` there is one fold: rows before it train, the rest test, scored in their own frame.
    The rows are read for the columns' means and once for the moments; a task then fits some blocks of
    ``target_block`` targets of one (outer fold, space), whose predictors it gets and factors once, and another
    joins each pair of spaces. Small outer folds take one task for all of that.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    checked_solver(solver)  # the data are z-scored: the solvers agree
    grid = checked_penalties(penalties)
    n, dims = checked_size(design), [int(d) for d in dims]
    p, f = sum(dims), len(dims)
    origin = column_means(design)
    v = len(origin) - p
    outer = last_bounds(n, n_folds) if train_end is None else None
    starts = segment_starts(n, outer, inner, splits, train_end)
    folds = list(zip(outer[:-1].tolist(), outer[1:].tolist())) if outer is not None else [(train_end, n)]
    frame = "global" if outer is not None else "test"
    spaces, blocks = space_columns(dims), target_blocks(v, target_block)
    moments = segment_moments(design, starts, origin, spaces, v, target_block)
    if len(blocks) == 1 and len(starts) * (p + 1) * (p + v) * 8 <= FOLD_BYTES:
        fits, pairs = _whole_folds(moments, starts, folds, n, origin, spaces, v, inner, splits, method, frame, grid)
        return Fitted(design, dims, folds, n, inner, target_block, fits, checkpointed(_stats(fits, pairs, f, target_block)))
    every = [F.array(*[F.lit(k) for k in range(m)]) for m in (len(folds), f, len(blocks))]
    lanes = min(len(blocks), LANES)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Target blocks one after another, past the predictors' moments and eigenvectors of their fold and space."""
        for (k, i, _), groups in groupby(_ordered(batches), lambda row: row[:3]):
            own, fold, x = spaces[i], Fold(starts, *folds[k], n, inner, splits), None
            for b, rows in groupby(groups, lambda row: row[3]):
                if b < 0:
                    x = Moments.empty(len(starts), len(own), 0)
                    _fill(x, rows)
                    continue
                target = blocks[b]
                m = x.beside(target.stop - target.start)
                _fill(m, rows)
                shift = np.concatenate([origin[own], origin[p + target.start : p + target.stop]])
                got = fit_space(m, fold, np.arange(len(own)), method, splits, frame, grid, shift)
                yield _fit_row(k, i, b, got).to_batches()[0]

    wanted = moments.where("kind <> 'xx' OR i = j")
    tasks = wanted.withColumn("outer_fold", F.explode(every[0])).withColumn("space", F.explode(F.when(F.col("kind") == "sy", every[1]).otherwise(F.array("i"))))
    of_block = F.col("kind").isin("sy", "xy")
    tasks = tasks.withColumn("lane", F.explode(F.when(of_block, F.array(F.col("j") % lanes)).otherwise(F.array(*[F.lit(x) for x in range(lanes)]))))
    tasks = tasks.withColumn("block", F.when(of_block, F.col("j")).otherwise(-1))
    keys = ("outer_fold", "space", "lane")
    tasks = tasks.select(*keys, "block", "seg", "kind", "data").repartition(len(folds) * f * lanes, *keys).sortWithinPartitions(*keys, "block")
    fits = checkpointed(tasks.mapInArrow(one, FITS))

    def two(key, left, right):
        k, i, j, b = (x.as_py() for x in key)
        columns = {i: np.arange(dims[i]), j: np.arange(dims[i], dims[i] + dims[j])}
        m = from_rows(left, len(starts), columns, 0)
        weights = {s: np.frombuffer(w).reshape(inner + 1, dims[s], -1) for s, w in zip(right.column("space").to_pylist(), right.column("weights").to_pylist())}
        own, q = fit_pair(m, Fold(starts, *folds[k], n, inner, splits), columns[i], columns[j], weights[i], weights[j])
        stats = pa.StructArray.from_arrays([pa.array(own), pa.array(q)], ["own", "q"])
        return pa.table([*(pa.array([x], pa.int32()) for x in (k, i, j, b)), pa.ListArray.from_arrays(pa.array([0, len(stats)], pa.int32()), stats)], names=["outer_fold", "i", "j", "block", "stats"])

    pairs = None
    if f > 1:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(f) for j in range(i + 1, f)])
        keys = ["outer_fold", "p.i", "p.j", "block"]
        left = moments.where("kind = 'sx' OR (kind = 'xx' AND i < j)").withColumnsRenamed({"i": "a", "j": "b"})
        left = left.withColumn("p", F.explode(F.filter(each, lambda e: F.when(F.col("kind") == "sx", (e["i"] == F.col("a")) | (e["j"] == F.col("a"))).otherwise((e["i"] == F.col("a")) & (e["j"] == F.col("b"))))))
        left = left.withColumn("outer_fold", F.explode(every[0])).withColumn("block", F.explode(every[2]))
        left = left.select(*keys, "seg", "kind", F.col("a"), F.col("b"), "data").toDF("outer_fold", "pi", "pj", "block", "seg", "kind", "i", "j", "data")
        right = fits.select("outer_fold", "space", "block", "weights").withColumn("p", F.explode(F.filter(each, lambda e: (e["i"] == F.col("space")) | (e["j"] == F.col("space")))))
        right = right.select("outer_fold", F.col("p.i").alias("pi"), F.col("p.j").alias("pj"), "block", "space", "weights")
        names = ("outer_fold", "pi", "pj", "block")
        pairs = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(two, _PAIRS)
    return Fitted(design, dims, folds, n, inner, target_block, fits, checkpointed(_stats(fits, pairs, f, target_block)))


def _stats(fits: DataFrame, pairs: DataFrame | None, f: int, block: int) -> DataFrame:
    """Rows of ``STATS``: one per outer fold and target, from the rows of its spaces and pairs of spaces."""
    target = (F.col("block") * block + F.col("pos")).alias("target_id")
    own = fits.select("outer_fold", "block", "n", F.col("space").alias("i"), F.col("space").alias("j"), F.posexplode("stats").alias("pos", "s"))
    own = own.select("outer_fold", target, "n", "i", "j", "s.*")
    if pairs is not None:
        both = pairs.select("outer_fold", "block", "i", "j", F.posexplode("stats").alias("pos", "s"))
        own = own.unionByName(both.select("outer_fold", target, "i", "j", "s.*"), allowMissingColumns=True)
    at = lambda i, j, c: F.max(F.when((F.col("i") == min(i, j)) & (F.col("j") == max(i, j)), F.col(c)))
    first = lambda c: at(0, 0, c).alias(c)
    square = lambda c: F.array(*[at(i, j, c) for i in range(f) for j in range(f)]).alias(c)
    row = lambda c: F.array(*[at(i, i, c) for i in range(f)]).alias(c)
    wide = own.groupBy("outer_fold", "target_id").agg(*map(first, ("n", "base", "held", "alive", "train_alive")), row("cross"), square("own"), row("c"), square("q"))
    p = F.array(*[F.col("base") - F.col("cross")[i] - F.col("cross")[j] + F.col("own")[i * f + j] for i in range(f) for j in range(f)])
    return wide.select("outer_fold", "target_id", "n", F.col("held").alias("base"), "alive", "train_alive", p.alias("p"), "c", "q")


def fold_stats(design: DataFrame, dims: Sequence[int], n_folds: int = 4, **options) -> DataFrame:
    """Rows of ``STATS`` per (outer fold, target); see :func:`fit_folds`."""
    return fit_folds(design, dims, n_folds, **options).stats


# ---------------------------------------------------------------- weights, penalties, predictions


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as a table of a schema of numbers and arrays of doubles."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.table([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names=list(names))


def _whole(design: DataFrame, dims: Sequence[int], splits: int, penalties: Sequence[float] | None, target_block: int, schema: str, make) -> DataFrame:
    """``make(moments, split labels, penalties, origin)`` for every (space, target block) of the whole table."""
    n, grid, origin = checked_size(design), checked_penalties(penalties), column_means(design)
    p, spaces = int(sum(dims)), space_columns(dims)
    v = len(origin) - p
    if n < splits:
        raise ValueError(f"{n} rows do not make {splits} splits")
    starts, blocks = first_bounds(n, splits)[:-1], target_blocks(len(origin) - p, target_block)
    moments = segment_moments(design, starts, origin, spaces, v, target_block).where("kind <> 'xx' OR i = j")

    def run(key, batch):
        i, b = (x.as_py() for x in key)
        own, target = spaces[i], blocks[b]
        m = from_rows(batch, splits, {i: np.arange(len(own))}, target.stop - target.start)
        shift = np.concatenate([origin[own], origin[p + target.start : p + target.stop]])
        rows = [(i, target.start + t, *rest) for t, *rest in make(m, np.arange(splits), grid, shift)]
        return _table(rows, schema)

    every = [F.array(*[F.lit(k) for k in range(m)]) for m in (len(spaces), len(blocks))]
    tasks = moments.withColumn("space", F.explode(F.when(F.col("kind") == "sy", every[0]).otherwise(F.array("i"))))
    tasks = tasks.withColumn("block", F.explode(F.when(F.col("kind").isin("sy", "xy"), F.array("j")).otherwise(every[1])))
    return tasks.groupBy("space", "block").applyInArrow(run, schema)


def _factored(design: DataFrame, dims: Sequence[int], splits: int, penalties: Sequence[float] | None, target_block: int, schema: str, make) -> DataFrame:
    """:func:`_whole` by ``make(factors of the splits, penalties)``, for the solver that forms no products of columns."""
    n, grid, origin = checked_size(design), checked_penalties(penalties), column_means(design)
    spaces = space_columns(dims)
    v = len(origin) - int(sum(dims))
    if n < splits:
        raise ValueError(f"{n} rows do not make {splits} splits")
    starts, blocks = first_bounds(n, splits)[:-1], target_blocks(v, target_block)
    rows = tsqr.segment_factors(design, starts, origin, spaces, v, target_block)

    def run(key, batch):
        i, j = (x.as_py() for x in key)
        own, target = len(spaces[i]), blocks[j]
        data = dict(zip(batch.column("seg").to_pylist(), batch.column("data").to_pylist()))
        factors = [tsqr.Factor.unpacked(data[k], own, target.stop - target.start) for k in range(splits)]
        return _table([(i, target.start + t, *rest) for t, *rest in make(factors, grid)], schema)

    return rows.groupBy("i", "j").applyInArrow(run, schema)


def cross_val_ridge(design: DataFrame, dims: Sequence[int], splits: int = 10, penalties: Sequence[float] | None = None, solver: str = "plain", standardize: bool = True, target_block: int = TARGET_BLOCK) -> DataFrame:
    """``(space_id, target_id, penalty, weights)``: each target's best penalty and the refit on all rows.

    The search runs on z-scores within the splits; ``svd`` solves it by merged QR factors (:mod:`tsqr`),
    the others from moments. The refit is of z-scores too, or with ``standardize`` off of the columns as
    they are, where ``ridge_sk`` has an intercept.
    """
    schema = "space_id int, target_id int, penalty double, weights array<double>"
    if checked_solver(solver) == "svd" and standardize:

        def refit(factors, grid):
            w, best = tsqr.fit(factors, grid)
            return [(t, float(grid[best[t]]), w[:, t].tolist()) for t in range(len(best))]

        return _factored(design, dims, splits, penalties, target_block, schema, refit)

    def make(m, split, grid, shift):
        everything, columns = np.ones(len(split), bool), np.arange(m.p)
        side = m.select(everything)
        w, best = fit(m, everything, split, splits, columns, ~side.alive[: m.p], ~side.y_alive, grid)
        if not standardize:
            for value in np.unique(best):
                w[:, best == value] = solve_raw(side, shift, columns, value, solver)[:, best == value]
        return [(t, float(best[t]), w[:, t].tolist()) for t in range(len(best))]

    return _whole(design, dims, splits, penalties, target_block, schema, make)


def penalty_costs(design: DataFrame, dims: Sequence[int], splits: int = 10, penalties: Sequence[float] | None = None, target_block: int = TARGET_BLOCK, solver: str = "plain", standardize: bool = True) -> DataFrame:
    """``(space_id, target_id, i, penalty, cost)``: summed cost of every penalty of the grid (its position is i).

    Of z-scores within the splits, or with ``standardize`` off of the columns as they are, on which
    ``ridge_sk`` centres the fit.
    """
    schema = "space_id int, target_id int, i int, penalty double, cost double"
    listed = lambda cost, grid: [(t, i, float(value), float(cost[i, t])) for t in range(cost.shape[1]) for i, value in enumerate(grid)]
    if not standardize:
        checked_solver(solver)
        return _whole(design, dims, splits, penalties, target_block, schema, lambda m, split, grid, shift: listed(raw_costs(m, split, splits, shift, grid, solver), grid))
    if checked_solver(solver) == "svd":
        return _factored(design, dims, splits, penalties, target_block, schema, lambda factors, grid: listed(tsqr.costs(factors, grid), grid))

    def make(m, split, grid, shift):
        side = m.select(np.ones(len(split), bool))
        return listed(lambda_costs(m, np.ones(len(split), bool), split, splits, np.arange(m.p), ~side.alive[: m.p], ~side.y_alive, grid), grid)

    return _whole(design, dims, splits, penalties, target_block, schema, make)


def ridge_path(design: DataFrame, dims: Sequence[int], penalties: Sequence[float] | None = None, target_block: int = TARGET_BLOCK, solver: str = "plain") -> DataFrame:
    """``(space_id, target_id, i, penalty, weights)``: z-scored ridge on all rows at every penalty of the grid."""
    schema = "space_id int, target_id int, i int, penalty double, weights array<double>"
    listed = lambda w, grid: [(t, i, float(value), w[i, :, t].tolist()) for t in range(w.shape[2]) for i, value in enumerate(grid)]
    if checked_solver(solver) == "svd":
        return _factored(design, dims, 1, penalties, target_block, schema, lambda factors, grid: listed(tsqr.Standard(factors[0]).weights(grid), grid))

    def make(m, split, grid, shift):
        return listed(solve(m.select(np.ones(len(split), bool)), np.arange(m.p), grid), grid)

    return _whole(design, dims, 1, penalties, target_block, schema, make)


def train_variance(fitted: Fitted) -> DataFrame:
    """``(outer_fold, target_id, space_id, variance)`` of the train rows' out-of-fold predictions.

    Each validation fold is z-scored by itself, so the predictions' mean is 0 and the mean square is the variance.
    """
    rows = fitted.fits.select("outer_fold", "block", "space", F.posexplode("stats").alias("pos", "s"))
    return rows.select("outer_fold", (F.col("block") * fitted.target_block + F.col("pos")).alias("target_id"), F.col("space").alias("space_id"), F.col("s.own").alias("variance"))


def _sub(matrix: str, own: Sequence[int], f: int) -> Column:
    return F.array(*[F.col(matrix)[i * f + j] for i in own for j in own])


def _quadratic(matrix: Column, w: Column, f: int) -> Column:
    total = F.lit(0.0)
    for i in range(f):
        for j in range(f):
            total = total + w[i] * w[j] * matrix[i * f + j]
    return total


def weighted(stats: DataFrame, f: int, subset: Sequence[int] | None = None) -> DataFrame:
    """Stack weights ``w`` of the spaces in ``subset`` per (outer fold, target), with their sub-blocks."""
    own = list(range(f)) if subset is None else list(subset)
    cut = stats.select("outer_fold", "target_id", "n", "base", "alive", "train_alive", _sub("p", own, f).alias("p"), F.array(*[F.col("c")[i] for i in own]).alias("c"), _sub("q", own, f).alias("q"))
    return cut.withColumn("w", simplex_udf("p"))


def target_scores(stats: DataFrame, f: int, subset: Sequence[int] | None = None) -> DataFrame:
    """``(target_id, stacked_r2, stacked_train_r2)`` of the stack of a subset of the spaces."""
    g = f if subset is None else len(subset)
    w = F.col("w")
    fit_ = sum((w[i] * F.col("c")[i] for i in range(g)), F.lit(0.0))
    scored = weighted(stats, f, subset).select(
        "target_id", "n", "alive",
        (F.col("base") - 2.0 * fit_ + _quadratic(F.col("q"), w, g)).alias("ss"),
        F.when(F.col("train_alive"), 1.0 - _quadratic(F.col("p"), w, g)).otherwise(0.0).alias("train"),
    )
    return scored.groupBy("target_id").agg(
        F.when(F.bool_and("alive"), 1.0 - F.sum("ss") / F.sum("n")).otherwise(0.0).alias("stacked_r2"),
        F.avg("train").alias("stacked_train_r2"),
    )


def subset_scores(stats: DataFrame, f: int, subsets: Sequence[Sequence[int]]) -> DataFrame:
    """``(target_id, subset, stacked_r2)`` of the stacks of several subsets (``subset`` is the position), in one pass over the fits."""
    owns = [list(own) for own in subsets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, c, q = (_array(batch.column(i)) for i in (4, 5, 6))
            p, q = p.reshape(-1, f, f), q.reshape(-1, f, f)
            for k, own in enumerate(owns):
                w, at = simplex_weights(p[:, own][:, :, own]), q[:, own][:, :, own]
                ss = batch.column(3).to_numpy() - 2 * (w * c[:, own]).sum(1) + np.einsum("ni,nij,nj->n", w, at, w)
                yield pa.record_batch([batch.column(0), pa.array([k] * batch.num_rows, pa.int32()), batch.column(1), batch.column(2), pa.array(ss)], names=["target_id", "subset", "n", "alive", "ss"])

    rows = stats.select("target_id", "n", "alive", "base", "p", "c", "q").mapInArrow(run, "target_id int, subset int, n long, alive boolean, ss double")
    score = F.when(F.bool_and("alive"), 1.0 - F.sum("ss") / F.sum("n")).otherwise(0.0)
    return rows.groupBy("target_id", "subset").agg(score.alias("stacked_r2"))


def space_scores(stats: DataFrame, f: int) -> DataFrame:
    """``(target_id, space_id, r2, r2_weighted, r2_train, weight)`` per target and space."""
    each = [
        F.struct(
            F.lit(i).alias("space_id"),
            (F.col("base") - 2.0 * F.col("c")[i] + F.col("q")[i * f + i]).alias("ss"),
            (F.col("base") - 2.0 * F.col("w")[i] * F.col("c")[i] + F.col("w")[i] * F.col("w")[i] * F.col("q")[i * f + i]).alias("ssw"),
            F.when(F.col("train_alive"), 1.0 - F.col("p")[i * f + i]).otherwise(0.0).alias("train"),
            F.col("w")[i].alias("w"),
        )
        for i in range(f)
    ]
    rows = weighted(stats, f).select("target_id", "n", "alive", F.explode(F.array(*each)).alias("s"))
    score = lambda c: F.when(F.bool_and("alive"), 1.0 - F.sum(c) / F.sum("n")).otherwise(0.0)
    return rows.groupBy("target_id", F.col("s.space_id").alias("space_id")).agg(score("s.ss").alias("r2"), score("s.ssw").alias("r2_weighted"), F.avg("s.train").alias("r2_train"), F.avg("s.w").alias("weight"))


def fit_predict(design: DataFrame, p: int, n_folds: int = 10, normalize: bool = False, penalties: Sequence[float] | None = None, solver: str = "plain", target_block: int = TARGET_BLOCK) -> DataFrame:
    """``(target_id, corr, r2)`` of one space: predictions of z-scores, held against the raw targets
    (or, with ``normalize``, against their z-scores within each fold)."""
    checked_solver(solver)
    n, grid = checked_size(design), checked_penalties(penalties)
    origin = column_means(design)
    v, outer = len(origin) - p, last_bounds(n, n_folds)
    starts, blocks = segment_starts(n, outer, 0, n_folds), target_blocks(v, target_block)

    def run(key, batch):
        k, block = key[0].as_py(), blocks[key[1].as_py()]
        width = block.stop - block.start
        m = from_rows(batch, len(starts), {0: np.arange(p)}, width)
        a, b = int(outer[k]), int(outer[k + 1])
        test = (starts >= a) & (starts < b)
        position = np.where(starts < a, starts, starts - (b - a))
        side, held = m.select(~test), m.select(test)
        w, _ = fit(m, ~test, _labels(position, first_bounds(n - (b - a), n_folds)), n_folds, np.arange(p), ~side.alive[:p], ~side.y_alive, grid)
        unit = held.y_sd if not normalize else held.y_alive.astype(float)
        mean = held.y_mean + origin[p:][block] if not normalize else np.zeros(width)
        return pa.table(
            {
                "target_id": pa.array(range(block.start, block.stop), pa.int32()),
                "n": pa.array([held.n] * width, pa.int64()),
                "sy": pa.array(held.n * mean),
                "syy": pa.array(held.n * (unit**2 + mean**2)),
                "spy": pa.array(held.n * unit * (w * held.rxy).sum(0)),
                "spp": pa.array(_both(held, np.arange(p), np.arange(p), w, w)),
            }
        )

    moments = segment_moments(design, starts, origin, [np.arange(p)], v, target_block)
    tasks = moments.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in range(n_folds)])))
    tasks = tasks.withColumn("block", F.explode(F.when(F.col("kind").isin("sy", "xy"), F.array("j")).otherwise(F.array(*[F.lit(b) for b in range(len(blocks))]))))
    sums = tasks.groupBy("outer_fold", "block").applyInArrow(run, "target_id int, n long, sy double, syy double, spy double, spp double")
    sums = sums.groupBy("target_id").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "spy", "spp")])
    variance = F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2)
    usable = (variance > 0) & (F.col("spp") > 0)
    corr = F.when(usable, F.col("spy") / F.col("n") / F.when(usable, F.sqrt(variance * F.col("spp") / F.col("n")))).otherwise(float("nan"))
    ss = (F.col("syy") - 2.0 * F.col("spy") + F.col("spp")) / F.col("n")
    return sums.select("target_id", corr.alias("corr"), r2_of(ss, variance).alias("r2"))
