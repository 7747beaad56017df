"""Ridge by the singular values of tall, skinny designs, from merged QR factors.

XᵀX squares the condition of X: of nearly collinear columns it keeps half the digits, and at penalties
near 1e-6 the other half is what the weights are made of. Here no product of columns is ever formed.
Each task keeps the triangular factor R of its rows of [1 X], and QᵀY; two such pairs, one on top of the
other, have the factor and the product of all their rows, so pairs merge in rounds, by segment, like
sums do. Without its first row and column R belongs to the centred columns; scaled to unit variance, its
singular values give the weights of every penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.operators.moments import FAN, _matrix, target_blocks
from varistack.sources.tables import checkpointed

#: Rows of a segment that a task gathers before it factors them.
ROWS = 2048
#: ``data``: counts and extremes, then R and QᵀY side by side.
SCHEMA = "seg int, i int, j int, part int, data binary"


@dataclass
class Factor:
    """Rows of [1 X] as R and of Y as QᵀY (``c``), with the sum of squares of Y that Q misses, and extremes."""

    n: int
    r: np.ndarray
    c: np.ndarray
    rest: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Factor:
        z = np.concatenate([x, y], axis=1)
        low, high = (getattr(z, f)(axis=0, initial=i) for f, i in (("min", np.inf), ("max", -np.inf)))
        low, high = np.where(np.isfinite(z).all(axis=0), low, np.nan), high
        z = np.where(np.isfinite(z), z, 0.0)  # the columns are dead by their extremes
        p = x.shape[1]
        return cls._factored(len(z), np.concatenate([np.ones((len(z), 1)), z[:, :p]], axis=1), z[:, p:], 0.0, low, high)

    @classmethod
    def _factored(cls, n: int, a: np.ndarray, b: np.ndarray, rest, low: np.ndarray, high: np.ndarray) -> Factor:
        q, r = np.linalg.qr(a)
        c = q.T @ b
        return cls(n, r, c, rest + ((b - q @ c) ** 2).sum(axis=0), low, high)

    @classmethod
    def merged(cls, parts: list[Factor]) -> Factor:
        r, c = (np.concatenate([getattr(p, k) for p in parts]) for k in "rc")
        return cls._factored(sum(p.n for p in parts), r, c, sum(p.rest for p in parts), np.min([p.low for p in parts], axis=0), np.max([p.high for p in parts], axis=0))

    def packed(self) -> bytes:
        head = np.concatenate([[self.n], self.rest, self.low, self.high])
        return np.concatenate([head, np.concatenate([self.r, self.c], axis=1).ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data, p: int, v: int) -> Factor:
        values = np.frombuffer(data)
        n, rest, low, high = np.split(values[: 1 + v + 2 * (p + v)], [1, 1 + v, 1 + v + p + v])
        both = values[1 + v + 2 * (p + v) :].reshape(-1, p + 1 + v)
        return cls(int(n[0]), both[:, : p + 1], both[:, p + 1 :], rest, low, high)


class Standard:
    """A factor's columns and targets as z-scores: ``r`` and ``c`` of them, and which are alive."""

    def __init__(self, factor: Factor):
        p = factor.r.shape[1] - 1
        self.n, centred = factor.n, factor.r[1:, 1:]
        sd = np.sqrt((centred**2).sum(axis=0) / self.n)
        y_sd = np.sqrt(((factor.c[1:] ** 2).sum(axis=0) + factor.rest) / self.n)
        varies = factor.low < factor.high  # not so of a NaN
        self.alive, self.y_alive = varies[:p] & (sd > 0), varies[p:] & (y_sd > 0)
        self.r = centred * np.divide(1.0, sd, out=np.zeros_like(sd), where=self.alive)
        unit = np.divide(1.0, y_sd, out=np.zeros_like(y_sd), where=self.y_alive)
        self.c, self.rest = factor.c[1:] * unit, factor.rest * unit**2

    def weights(self, penalties: np.ndarray) -> np.ndarray:
        """``(penalty, column, target)``: one decomposition serves all; dead columns get 0."""
        u, s, vt = np.linalg.svd(self.r, full_matrices=False)
        right = u.T @ self.c
        shrunk = [s / np.where(s > 0, s * s + penalty, 1.0) for penalty in penalties]
        return np.stack([vt.T @ (k[:, None] * right) for k in shrunk])

    def cost(self, weights: np.ndarray) -> np.ndarray:
        """1 - R² of weights ``(penalty, column, target)`` on these rows; 1 of a dead target."""
        miss = self.c - self.r @ weights
        return np.where(self.y_alive, ((miss**2).sum(axis=-2) + self.rest) / self.n, 1.0)


def segment_factors(design: DataFrame, starts: np.ndarray, origin: np.ndarray, spaces: list[np.ndarray], v: int, block: int) -> DataFrame:
    """Rows of ``SCHEMA``, one per segment, space ``i`` and target block ``j``, checkpointed."""
    p, blocks = len(origin) - v, target_blocks(v, block)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, waiting = TaskContext.get().partitionId(), {}, {}

        def flush(seg: int) -> None:
            z = np.concatenate(waiting.pop(seg))
            for i, own in enumerate(spaces):
                for j, b in enumerate(blocks):
                    new = Factor.of(z[:, own], z[:, p + b.start : p + b.stop])
                    held[seg, i, j] = Factor.merged([held[seg, i, j], new]) if (seg, i, j) in held else new

        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch) - origin
            segs = np.searchsorted(starts, batch.column(batch.schema.get_field_index("t")).to_numpy(), "right") - 1
            for seg in np.unique(segs).tolist():
                waiting.setdefault(seg, []).append(z[segs == seg])
                if sum(map(len, waiting[seg])) >= ROWS:
                    flush(seg)
        for seg in list(waiting):
            flush(seg)
        for key, factor in held.items():
            columns = [pa.array([k], pa.int32()) for k in (*key, part)]
            yield pa.record_batch([*columns, pa.array([factor.packed()], pa.binary())], names=["seg", "i", "j", "part", "data"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, i, j, part = (k.as_py() for k in key)
        width, total = blocks[j].stop - blocks[j].start, None
        for data in (d for batch in batches for d in batch.column(batch.schema.get_field_index("data"))):
            own = Factor.unpacked(data.as_buffer(), len(spaces[i]), width)
            total = own if total is None else Factor.merged([total, own])
        columns = [pa.array([k], pa.int32()) for k in (seg, i, j, part)]
        yield pa.record_batch([*columns, pa.array([total.packed()], pa.binary())], names=["seg", "i", "j", "part", "data"])

    rows = checkpointed(design.select("t", "x", "y").mapInArrow(partial, SCHEMA))
    while True:
        parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
        rows = rows.withColumn("part", (F.col("part") / FAN).cast("int"))
        rows = checkpointed(rows.groupBy("seg", "i", "j", "part").applyInArrow(merge, SCHEMA))
        if parts <= FAN:
            return rows


def costs(segments: list[Factor], penalties: np.ndarray) -> np.ndarray:
    """Summed cost (penalty, target) of leaving each segment out in turn.

    A split in which a column is dead on either side says nothing: its cost is 1, as that of a target that is.
    """
    whole = Standard(Factor.merged(segments))
    total = np.zeros((len(penalties), len(whole.y_alive)))
    for k, own in enumerate(segments):
        train, held = Standard(Factor.merged(segments[:k] + segments[k + 1 :])), Standard(own)
        if not (whole.alive.all() and train.alive.all() and held.alive.all()):
            total += 1.0
            continue
        total += np.where(train.y_alive & held.y_alive & whole.y_alive, held.cost(train.weights(penalties)), 1.0)
    return total


def fit(segments: list[Factor], penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(weights (column, target), position of each target's penalty)``, refitted on all segments."""
    choice = costs(segments, penalties).argmin(axis=0)
    side = Standard(Factor.merged(segments))
    weights = np.zeros((side.r.shape[1], len(choice)))
    for i in np.unique(choice[side.y_alive]):
        own = side.y_alive & (choice == i)
        weights[:, own] = side.weights(penalties[i : i + 1])[0][:, own]
    return weights, choice
