"""Mergeable moments of contiguous row segments, and the statistics of any union of segments.

All folds and splits of nested cross-validation are unions of contiguous segments of the row order.
One pass sums, per segment, counts, sums, cross products and extremes of the columns; everything that
R² needs of a split follows from these, so fits never read a row again.

Cross products travel in blocks of one pair of predictor spaces, or of a space and a block of targets,
so that a row is bounded by the spaces' sizes and a fit receives only the blocks it needs. Each map
task sums what it has per segment; the tasks' sums are merged in rounds of at most ``FAN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varistack.sources.tables import checkpointed

#: Rows of moments: count, sums, squares, extremes of a space's columns (``sx``, i) and of a target block's
#: (``sy``, j), and cross products of two spaces (``xx``, i <= j) and of a space and a target block (``xy``).
SCHEMA = "seg int, kind string, i int, j int, part int, data binary"
#: Partial sums that one merge task adds up.
FAN = 32
#: Bytes of partial sums beyond which rows are dealt by ranges first, so that a task sums one segment after another.
HELD_BYTES = 256 << 20


def last_bounds(n: int, k: int) -> np.ndarray:
    """Starts of k contiguous folds with the remainder in the last, and n."""
    if n < k:
        raise ValueError(f"{n} rows do not make {k} folds")
    return np.append(np.arange(k) * (n // k), n)


def first_bounds(n: int, k: int) -> np.ndarray:
    """Starts of k contiguous folds with the remainder spread over the first ones, and n."""
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    return np.concatenate([[0], np.cumsum(sizes)])


def without(position: np.ndarray, a: int, b: int) -> np.ndarray:
    """Map positions in the sequence with [a, b) removed back to positions in the whole."""
    return np.where(position < a, position, position + (b - a))


def segment_starts(n: int, outer: np.ndarray | None, inner: int, splits: int, train_end: int | None = None) -> np.ndarray:
    """Starts of the elementary segments of all outer folds, inner folds and λ-search splits.

    ``outer`` are bounds of outer folds, each removed in turn; or None with ``train_end`` for one
    given split into train rows [0, train_end) and test rows. ``inner`` of 0 leaves the inner folds out.
    """
    cuts = [np.array([0])]
    removed = [(a, b) for a, b in zip(outer[:-1], outer[1:])] if outer is not None else [(train_end, n)]
    for a, b in removed:
        cuts += [np.array([a, b])]
        size = n - (b - a)
        cuts.append(without(first_bounds(size, splits)[:-1], a, b))
        if inner:
            bounds = last_bounds(size, inner)
            cuts.append(without(bounds[:-1], a, b))
            for c, d in zip(bounds[:-1], bounds[1:]):
                cuts.append(without(without(first_bounds(size - (d - c), splits)[:-1], c, d), a, b))
    starts = np.unique(np.concatenate(cuts))
    return starts[starts < n]


@dataclass
class Moments:
    """Moments of S segments over p predictors and V targets, all shifted by a common origin.

    Axes between the segments and the columns, if any, are tables of one shape that are fitted at once.
    """

    n: np.ndarray
    s: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    low: np.ndarray
    high: np.ndarray
    p: int
    #: Eigenvectors of predictors by segments and columns, shared by the target blocks of a space; None keeps none.
    eigen: dict | None = None
    #: Statistics by segments, where several spaces ask for the same ones; None keeps none.
    sides: dict | None = None

    @classmethod
    def empty(cls, segments: int, p: int, v: int) -> Moments:
        return cls(np.zeros(segments, np.int64), np.zeros((segments, p + v)), np.zeros((segments, p, p)), np.zeros((segments, p, v)), np.zeros((segments, v)), np.full((segments, p + v), np.inf), np.full((segments, p + v), -np.inf), p)

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        """One segment's rows."""
        z = np.concatenate([x, y], axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            return cls(np.array([len(z)]), z.sum(0)[None], (x.T @ x)[None], (x.T @ y)[None], (y * y).sum(0)[None], z.min(0)[None], z.max(0)[None], x.shape[1])

    def beside(self, v: int) -> Moments:
        """These predictors with ``v`` targets that are to be filled in; eigenvectors are kept from now on."""
        if self.eigen is None:
            self.eigen = {}
        wide = lambda a, fill: np.concatenate([a[:, : self.p], np.full((len(a), v), fill)], axis=1)
        xy, yy = np.zeros((len(self.n), self.p, v)), np.zeros((len(self.n), v))
        return Moments(self.n, wide(self.s, 0.0), self.xx, xy, yy, wide(self.low, np.inf), wide(self.high, -np.inf), self.p, self.eigen)

    def add(self, other: Moments) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            for name in ("n", "s", "xx", "xy", "yy"):
                getattr(self, name).__iadd__(getattr(other, name))
            self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)

    def select(self, mask: np.ndarray) -> Side:
        if self.sides is None:
            return Side(self, mask)
        key = mask.tobytes()
        if key not in self.sides:
            self.sides[key] = Side(self, mask)
        return self.sides[key]


class Side:
    """Statistics of the union of some segments: standardised moments and which columns are usable.

    A constant column, or one with a NaN or an infinity, is dead: its z-scores are 0.
    """

    def __init__(self, m: Moments, mask: np.ndarray):
        p = m.p
        self.n = int(m.n[mask].sum())
        s, low, high = m.s[mask].sum(0), m.low[mask].min(0, initial=np.inf), m.high[mask].max(0, initial=-np.inf)
        xx, xy, yy = m.xx[mask].sum(0), m.xy[mask].sum(0), m.yy[mask].sum(0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            mean = s / self.n
            diag = np.concatenate([np.diagonal(xx, axis1=-2, axis2=-1), yy], axis=-1) / self.n - mean * mean
            self.alive = np.isfinite(s) & np.isfinite(low) & np.isfinite(high) & (low < high) & (diag > 0)
            sd = np.where(self.alive, np.sqrt(np.where(self.alive, diag, 1.0)), 0.0)
        inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        mean = np.where(np.isfinite(mean), mean, 0.0)
        outer = lambda a, own: a[..., :p, None] * a[..., None, own]
        for name, sums, own in (("rxx", xx, slice(p)), ("rxy", xy, slice(p, None))):
            centred = np.nan_to_num(sums / max(1, self.n) - outer(mean, own))
            setattr(self, name, np.where(outer(self.alive, own), centred, 0.0) * outer(inverse, own))
        self.mean, self.sd, self.p = mean, sd, p
        self._eigen, self._mask = m.eigen, mask.tobytes()

    def eigen(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of the columns' n times correlations."""
        key = self._mask, columns.tobytes()
        if self._eigen is not None and key in self._eigen:
            return self._eigen[key]
        found = np.linalg.eigh(self.n * self.rxx[..., columns[:, None], columns])
        if self._eigen is not None:
            self._eigen[key] = found
        return found

    @property
    def y_mean(self) -> np.ndarray:
        return self.mean[..., self.p :]

    @property
    def y_sd(self) -> np.ndarray:
        return self.sd[..., self.p :]

    @property
    def y_alive(self) -> np.ndarray:
        return self.alive[..., self.p :]


def column_means(design: DataFrame) -> np.ndarray:
    """Finite means of the predictors, then the targets: an origin against cancellation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            z = _matrix(batch)
            own = np.where(np.isfinite(z), z, 0.0).sum(0)
            total, n = own if total is None else total + own, n + len(z)
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], names=["i", "s", "n"])

    sums = design.select("x", "y").mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"))
    rows = sorted(map(tuple, sums.collect()))  # a row per column
    return np.array([m for _, m in rows])


def _array(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of ``x`` then ``y``; nulls become NaN."""
    return np.concatenate([_array(batch.column(batch.schema.get_field_index(c))) for c in ("x", "y")], axis=1)


def target_blocks(v: int, block: int) -> list[slice]:
    return [slice(a, min(a + block, v)) for a in range(0, v, block)]


def _rows(held: dict[int, Moments], spaces: list[np.ndarray], blocks: list[slice], part: int) -> Iterator[pa.RecordBatch]:
    for seg, m in held.items():
        p, rows = m.p, []
        for i, own in enumerate(spaces):
            rows.append(("sx", i, 0, np.stack([np.full(len(own), m.n[0]), m.s[0][own], np.diag(m.xx[0])[own], m.low[0][own], m.high[0][own]])))
            rows += [("xx", i, j, m.xx[0][np.ix_(own, spaces[j])]) for j in range(i, len(spaces))]
            rows += [("xy", i, j, m.xy[0][own, b]) for j, b in enumerate(blocks)]
        for j, b in enumerate(blocks):
            y = slice(p + b.start, p + b.stop)
            rows.append(("sy", 0, j, np.stack([np.full(b.stop - b.start, m.n[0]), m.s[0][y], m.yy[0][b], m.low[0][y], m.high[0][y]])))
        kind, i, j, data = zip(*rows)
        same = [pa.array([x] * len(rows), pa.int32()) for x in (seg, part)]
        yield pa.record_batch([same[0], pa.array(kind), pa.array(i, pa.int32()), pa.array(j, pa.int32()), same[1], pa.array([d.astype(np.float64).tobytes() for d in data], pa.binary())], names=["seg", "kind", "i", "j", "part", "data"])


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all rows of a group, one after another; the last rows of ``sx`` and ``sy`` are extremes."""
    kind, total = key[1].as_py(), None
    extremes = 5 if kind in ("sx", "sy") else None
    for data in (d for batch in batches for d in batch.column(batch.schema.get_field_index("data"))):
        own = np.frombuffer(data.as_buffer()).reshape(extremes or 1, -1)
        if total is None:
            total = own.copy()
        elif extremes:
            total[:-2] += own[:-2]
            with np.errstate(invalid="ignore"):
                total[-2], total[-1] = np.minimum(total[-2], own[-2]), np.maximum(total[-1], own[-1])
        else:
            total += own
    columns = [pa.array([k.as_py()], t) for k, t in zip(key, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
    yield pa.record_batch([*columns, pa.array([total.tobytes()], pa.binary())], names=["seg", "kind", "i", "j", "part", "data"])


def segment_moments(design: DataFrame, starts: np.ndarray, origin: np.ndarray, spaces: list[np.ndarray], v: int, block: int) -> DataFrame:
    """Rows of ``SCHEMA``, one of each kind and block per segment, checkpointed.

    ``design`` has ``t`` (dense, 0-based), ``x`` and ``y``.
    """
    p, blocks = len(origin) - v, target_blocks(v, block)
    if len(starts) * (p + 1) * (p + v) * 8 > HELD_BYTES:
        design = design.repartitionByRange("t").sortWithinPartitions("t")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch) - origin
            seg = np.searchsorted(starts, batch.column(batch.schema.get_field_index("t")).to_numpy(), "right") - 1
            for g in np.unique(seg).tolist():
                own = Moments.of(z[seg == g, :p], z[seg == g, p:])
                if g in held:
                    held[g].add(own)
                else:
                    if len(held) * (p + 1) * (p + v) * 8 > HELD_BYTES:
                        yield from _rows(held, spaces, blocks, part)
                        held = {}
                    held[g] = own
        yield from _rows(held, spaces, blocks, part)

    rows = checkpointed(design.select("t", "x", "y").mapInArrow(partial, SCHEMA))
    while True:
        parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
        rows = rows.withColumn("part", (F.col("part") / FAN).cast("int"))
        rows = checkpointed(rows.groupBy("seg", "kind", "i", "j", "part").applyInArrow(_merged, SCHEMA))
        if parts <= FAN:
            return rows


def from_rows(table: pa.Table, segments: int, columns: dict[int, np.ndarray], v: int) -> Moments:
    """Moments of all segments over the spaces in ``columns`` (space -> its columns here) from rows of ``SCHEMA``."""
    p = sum(map(len, columns.values()))
    out = Moments.empty(segments, p, v)
    for seg, kind, i, j, data in zip(*(table.column(c).to_pylist() for c in ("seg", "kind", "i", "j", "data"))):
        values = np.frombuffer(data)
        if kind == "sx":
            own = columns[i]
            n, out.s[seg, own], out.xx[seg, own, own], out.low[seg, own], out.high[seg, own] = values.reshape(5, -1)
            out.n[seg] = n[0]
        elif kind == "sy":
            n, out.s[seg, p:], out.yy[seg], out.low[seg, p:], out.high[seg, p:] = values.reshape(5, -1)
            out.n[seg] = n[0]
        elif kind == "xy":
            out.xy[seg, columns[i]] = values.reshape(len(columns[i]), v)
        else:
            out.xx[np.ix_([seg], columns[i], columns[j])] = values.reshape(1, len(columns[i]), len(columns[j]))
            if i != j:
                out.xx[np.ix_([seg], columns[j], columns[i])] = values.reshape(len(columns[i]), len(columns[j])).T
    return out


def gram(design: DataFrame, dims: Sequence[int]) -> DataFrame:
    """``(i, j, g)``: XᵀX over all rows of ``x``, from blocks of pairs of spaces."""
    p, ends = int(sum(dims)), np.cumsum(dims)
    begins = (ends - np.array(dims)).tolist()
    flat = design.select("t", "x", F.array(F.lit(0.0)).alias("y"))
    rows = segment_moments(flat, np.array([0]), np.zeros(p + 1), [np.arange(a, b) for a, b in zip(begins, ends)], 1, 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                block = np.frombuffer(data).reshape(dims[i], dims[j])
                a, b = (x.ravel() for x in np.meshgrid(np.arange(dims[i]) + begins[i], np.arange(dims[j]) + begins[j], indexing="ij"))
                sides = [(a, b)] if i == j else [(a, b), (b, a)]
                for x, y in sides:
                    yield pa.record_batch([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(block.ravel())], names=["i", "j", "g"])

    return rows.where("kind = 'xx'").select("i", "j", "data").mapInArrow(cells, "i int, j int, g double")


def segment_sums(rows: DataFrame) -> DataFrame:
    """``(seg, n, s, sxy, low, high)`` from rows of ``SCHEMA`` for one predictor and one target: the
    predictor's sum and extremes and its product with the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(d) for d in batch.column(2).to_pylist()]
            is_x = [k == "sx" for k in batch.column(1).to_pylist()]
            pick = lambda at: pa.array([float(v[at]) if x else None for v, x in zip(values, is_x)], pa.float64())
            product = pa.array([None if x else float(v[0]) for v, x in zip(values, is_x)], pa.float64())
            yield pa.record_batch([batch.column(0), pick(0), pick(1), product, pick(3), pick(4)], names=["seg", "n", "s", "sxy", "low", "high"])

    each = rows.where("kind IN ('sx', 'xy')").select("seg", "kind", "data").mapInArrow(run, "seg int, n double, s double, sxy double, low double, high double")
    return each.groupBy("seg").agg(*[F.max(c).alias(c) for c in ("n", "s", "sxy", "low", "high")])
