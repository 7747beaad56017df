"""Ridge on all spaces side by side, at any width, and on every subset of a chain of them.

An outer fold needs its column moments over each split of the penalty search and over its test rows, no
inner folds. Spark adds the segments of each of those pieces up, and then gives a task one piece, the total
and one block of targets: it fits the rest of the rows and scores the piece. So it holds two matrices
of moments, whatever the number of folds, splits and segments.

A chain of subsets costs no fit of its own: with the spaces ordered so that those removed first come
last, every subset is a leading block, whose Cholesky factor is the leading block of the whole one. The
forward substitution is shared, too; a subset takes a back substitution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.operators.moments import SCHEMA, Moments, Side, _merged, column_means, first_bounds, last_bounds, segment_moments, target_blocks, without
from varistack.operators.predict import scored
from varistack.operators.ridge import val_cost
from varistack.operators.stack import SPLITS, TARGET_BLOCK, _table, checked_penalties, checked_size, fit_folds, space_columns, target_scores
from varistack.sources.tables import checkpointed

DIRECTIONS = ("forward", "backward")
#: Bytes of the products of all columns and a block of targets.
BLOCK_BYTES = 64 << 20
_COSTS = "outer_fold int, block int, chain int, step int, cost binary"
_SCORES = "chain int, step int, target_id int, n long, alive boolean, ss double"


def chain_steps(dims: Sequence[int], directions: Sequence[str]) -> list[tuple[np.ndarray, list[int]]]:
    """Per direction the columns in an order in which each step's are the leading ones, and how many they are."""
    spaces, out = space_columns(dims), []
    for direction in directions:
        if direction not in DIRECTIONS:
            raise ValueError(f"unknown direction {direction!r}")
        kept = spaces[::-1] if direction == "forward" else spaces
        sizes = np.cumsum([len(s) for s in kept])
        out.append((np.concatenate(kept), sizes[::-1].tolist()))
    return out


def nested_weights(system: np.ndarray, right: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """The solutions of the leading blocks of a positive definite system, from its one Cholesky factor."""
    lower = np.linalg.cholesky(system)
    forward = _substituted(lower, right)
    return [_substituted(lower[:m, :m].T[::-1, ::-1], forward[:m][::-1])[::-1] for m in sizes]


def _substituted(lower: np.ndarray, right: np.ndarray, block: int = 64) -> np.ndarray:
    """Forward substitution in blocks of rows, each a small solve after one product with what is known."""
    out = np.zeros_like(right)
    for a in range(0, len(lower), block):
        b = min(a + block, len(lower))
        out[a:b] = np.linalg.solve(lower[a:b, a:b], right[a:b] - lower[a:b, :a] @ out[:a])
    return out


def _pieces(n: int, outer: np.ndarray, splits: int, starts: np.ndarray) -> list[np.ndarray]:
    """Per outer fold the piece of each segment: its split of the search, or ``splits`` for test rows."""
    out = []
    for a, b in zip(outer[:-1], outer[1:]):
        position = np.where(starts < a, starts, starts - (b - a))
        split = np.searchsorted(first_bounds(n - (b - a), splits)[:-1], position, "right") - 1
        out.append(np.where((starts >= a) & (starts < b), splits, split))
    return out


def _read(table: pa.Table) -> tuple[dict, dict, dict]:
    """The total's, the piece's and the other pieces' moments by kind; of the last, only extremes."""
    roles: dict[str, dict] = {"whole": {}, "held": {}, "rest": {}}
    for role, kind, data in zip(*(table.column(c).to_pylist() for c in ("role", "kind", "data"))):
        values = np.frombuffer(data)
        if role == "rest":
            low, high = values.reshape(5, -1)[3:]
            before = roles[role].get(kind, (low, high))
            values = np.minimum(before[0], low), np.maximum(before[1], high)
        roles[role][kind] = values
    return roles["whole"], roles["held"], roles["rest"]


def _moments(part: dict, p: int) -> Moments:
    x, y = part["sx"].reshape(5, -1), part["sy"].reshape(5, -1)
    s, low, high = (np.concatenate([x[i], y[i]])[None] for i in (1, 3, 4))
    return Moments(x[0, :1].astype(np.int64), s, part["xx"].reshape(1, p, p), part["xy"].reshape(1, p, -1), y[2][None], low, high, p)


def _system(side: Side, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return side.n * side.rxx[np.ix_(order, order)], side.n * side.rxy[order]


def concat_scores(design: DataFrame, dims: Sequence[int], n_folds: int = 5, directions: Sequence[str] = ("forward",), whole_only: bool = False, splits: int = SPLITS, penalties: Sequence[float] | None = None, target_block: int | None = None) -> DataFrame:
    """``(target_id, direction, step, r2)`` of one ridge on the spaces that a chain has kept, by outer folds.

    Step 0 has all spaces; ``whole_only`` leaves the other steps out. Targets are scored on z-scores of
    all rows. Penalties must be positive.
    """
    n, grid, origin = checked_size(design), checked_penalties(penalties), column_means(design)
    if not (grid > 0).all():
        raise ValueError("penalties must be positive")
    p = int(sum(dims))
    v, outer = len(origin) - p, last_bounds(n, n_folds)
    cuts = [np.array([0])]
    for a, b in zip(outer[:-1], outer[1:]):
        cuts += [np.array([a, b]), without(first_bounds(n - (b - a), splits)[:-1], a, b)]
    starts = np.unique(np.concatenate(cuts))
    starts = starts[starts < n]
    width = target_block or int(np.clip(BLOCK_BYTES // (8 * p), 1, TARGET_BLOCK))
    blocks, pieces = target_blocks(v, width), _pieces(n, outer, splits, starts)
    chains = [(order, sizes[:1] if whole_only else sizes) for order, sizes in chain_steps(dims, directions)]
    moments = segment_moments(design, starts, origin, [np.arange(p)], v, width)

    def summed(rows: DataFrame, seg) -> DataFrame:
        rows = rows.withColumn("seg", seg).withColumn("part", F.lit(0))
        return checkpointed(rows.groupBy("seg", "kind", "i", "j", "part").applyInArrow(_merged, SCHEMA))

    # a segment is in one piece of every outer fold; pieces are numbered fold by fold
    label = F.array(*[F.array(*[F.lit(int(k * (splits + 1) + piece)) for piece in own]) for k, own in enumerate(pieces)])
    piece = summed(moments, F.explode(F.transform(label, lambda own: own[F.col("seg")])))
    fold, at = (F.col("seg") / (splits + 1)).cast("int"), F.col("seg") % (splits + 1)
    total = summed(piece.where(at < splits), fold)
    every = summed(piece.where((fold == 0) & (F.col("kind") == "sy")), F.lit(0))
    each = lambda m: F.array(*[F.lit(c) for c in range(m)])
    targets = F.explode(F.when(F.col("kind").isin("sy", "xy"), F.array("j")).otherwise(each(len(blocks)))).alias("block")
    part = lambda rows, of, fit, role: rows.select(of.alias("outer_fold"), "kind", "j", "data", fit.alias("fit"), F.lit(role).alias("role"))
    tasks = part(total, F.col("seg"), F.explode(each(splits + 1)), "whole").unionByName(part(piece, fold, at, "held"))
    others = F.explode(F.filter(each(splits), lambda c: c != at))
    tasks = tasks.unionByName(part(piece.where(F.col("kind").isin("sx", "sy") & (at < splits)), fold, others, "rest"))
    tasks = tasks.select("outer_fold", "fit", "role", "kind", "data", targets)

    def search(key, rows):
        k, _, b = (x.as_py() for x in key)
        whole, held, rest = _read(rows)
        low, high = (np.concatenate([rest["sx"][i], rest["sy"][i]])[None] for i in (0, 1))
        a, c = _moments(whole, p), _moments(held, p)
        fitted = Moments(a.n - c.n, a.s - c.s, a.xx - c.xx, a.xy - c.xy, a.yy - c.yy, low, high, p)
        every_row = np.ones(1, bool)
        a, fitted, c = (m.select(every_row) for m in (a, fitted, c))
        usable = a.alive[:p] & fitted.alive[:p] & c.alive[:p]
        alive, out = a.y_alive & fitted.y_alive & c.y_alive, []
        for which, (order, sizes) in enumerate(chains):
            # a dead column says nothing of any penalty, so subsets that hold one keep their costs of 1
            sound = [m for m in sizes if usable[order[:m]].all()]
            cost = {m: np.ones((len(grid), len(alive))) for m in sizes}
            if sound:
                system, right = _system(fitted, order[: sound[0]])
                for i, penalty in enumerate(grid):
                    for m, w in zip(sound, nested_weights(system + penalty * np.eye(len(system)), right, sound)):
                        cost[m][i] = np.where(alive, val_cost(w[None], c, order[:m])[0], 1.0)
            out += [(k, b, which, s, cost[m].tobytes()) for s, m in enumerate(sizes)]
        return pa.table([pa.array(x, pa.binary() if i == 4 else pa.int32()) for i, x in enumerate(zip(*out))], names=[x.split()[0] for x in _COSTS.split(", ")])

    def score(key, left, right):
        block, total_cost, out = blocks[key[1].as_py()], {}, []
        for c, s, cost in zip(*(right.column(x).to_pylist() for x in ("chain", "step", "cost"))):
            total_cost[c, s] = total_cost.get((c, s), 0.0) + np.frombuffer(cost).reshape(len(grid), -1)
        frame = np.frombuffer(left.filter(pc.equal(left.column("role"), "every")).column("data")[0].as_py()).reshape(5, -1)
        whole, held, _ = _read(left.filter(pc.not_equal(left.column("role"), "every")))
        side, test = (_moments(m, p).select(np.ones(1, bool)) for m in (whole, held))
        count, y_sum, y_square, low, high = frame
        with np.errstate(invalid="ignore"):
            mean = y_sum / count
            variance = y_square / count - mean**2
            alive = np.isfinite(y_sum) & np.isfinite(low) & np.isfinite(high) & (low < high) & (variance > 0)
        mean, unit = np.where(alive, mean, 0.0), np.where(alive, 1.0 / np.sqrt(np.where(alive, variance, 1.0)), 0.0)
        base = test.n * (test.y_sd**2 + (test.y_mean - mean) ** 2) * unit**2
        for c, (order, sizes) in enumerate(chains):
            kept, choice = order[side.alive[order]], [total_cost[c, s].argmin(axis=0) for s in range(len(sizes))]
            counts = [int(side.alive[order[:m]].sum()) for m in sizes]
            weights = [np.zeros((m, len(alive))) for m in counts]
            system, right_side = _system(side, kept)
            for i in np.unique(np.concatenate(choice)) if len(kept) else []:
                for s, w in enumerate(nested_weights(system + grid[i] * np.eye(len(kept)), right_side, counts)):
                    own = side.y_alive & (choice[s] == i)
                    weights[s][:, own] = w[:, own]
            for s, (m, w) in enumerate(zip(counts, weights)):
                cross = test.n * test.y_sd * unit * (w * test.rxy[kept[:m]]).sum(0)
                both = test.n * (w * (test.rxx[np.ix_(kept[:m], kept[:m])] @ w)).sum(0)
                out += [(c, s, block.start + t, test.n, bool(alive[t]), ss) for t, ss in enumerate((base - 2 * cross + both).tolist())]
        return _table(out, _SCORES)

    keys = ("outer_fold", "block")
    found = checkpointed(tasks.where(F.col("fit") < splits).groupBy("outer_fold", "fit", "block").applyInArrow(search, _COSTS))
    final = tasks.where((F.col("fit") == splits) & (F.col("role") != "rest")).select(*keys, "role", "kind", "data")
    final = final.unionByName(every.select(F.explode(each(n_folds)).alias("outer_fold"), F.col("j").alias("block"), F.lit("every").alias("role"), "kind", "data"))
    rows = final.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(score, _SCORES)
    named = F.array(*[F.lit(d) for d in directions])[F.col("chain")]
    r2 = F.when(F.bool_and("alive"), 1.0 - F.sum("ss") / F.sum("n")).otherwise(0.0)
    return rows.groupBy("target_id", named.alias("direction"), "step").agg(r2.alias("r2"))


def concat_chain(design: DataFrame, dims: Sequence[int], n_folds: int = 5, directions: Sequence[str] = DIRECTIONS, **options) -> DataFrame:
    """``(target_id, direction, step, r2)``: the concatenated model as spaces are removed from the front or the back."""
    return concat_scores(design, dims, n_folds, directions, **options)


def concat_cv(design: DataFrame, dims: Sequence[int], n_folds: int = 5, method: str = "cross_val_ridge", score=None, **options) -> DataFrame:
    """``(target_id, concat_r2)``: one ridge on all spaces side by side; by a mergeable ``score`` if given, or at one penalty (``simple_ridge``)."""
    if score is None and method == "cross_val_ridge":
        return concat_scores(design, dims, n_folds, whole_only=True, **options).select("target_id", F.col("r2").alias("concat_r2"))
    fitted = fit_folds(design, [int(sum(dims))], n_folds, method, **options)
    if score is not None:
        return scored(fitted, score).where("space_id IS NOT NULL").select("target_id", F.col("score").alias("concat_r2"))
    return target_scores(fitted.stats, 1).select("target_id", F.col("stacked_r2").alias("concat_r2"))
