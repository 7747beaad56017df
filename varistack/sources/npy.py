"""Chains of R² in ``.npy`` files, one per direction, step and shard, as a Python data source.

``spark.read.format("npy_chain").load(folder)`` gives ``(direction, step, shard, row, r2)``. Files are named
``{step}_stacked_r2s_{shard}.npy`` in the forward and ``{step}_r_stacked_r2s_{shard}.npy`` in the backward
direction (fixed names); others are not read. Conditions on direction, step and shard are held against the
names, so that only their files are opened; a file is read by ranges of rows through a memory map.
Writing appends: each task writes its files beside their places, and the commit of the job moves them there.

The folder must be mounted on driver and executors, as NumPy reads it. Values of more than one dimension
are taken in their order, as one row each.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "direction string, step int, shard int, row long, r2 double"
#: Rows of one partition.
ROWS = 1 << 20
_NAME = re.compile(r"(\d+)_(r_)?stacked_r2s_(\d+)\.npy")
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


def local(path: str) -> str:
    """The mounted folder of a path; other file systems raise."""
    plain = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in plain:
        raise ValueError(f"{path} is not mounted: NumPy's files are read from a folder")
    return plain


def file_name(direction: str, step: int, shard: int) -> str:
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    return f"{step}_{'r_' if direction == 'backward' else ''}stacked_r2s_{shard}.npy"


@dataclass
class Range(InputPartition):
    direction: str
    step: int
    shard: int
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    moves: list


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.kept = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on what the names say; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if name in ("direction", "step", "shard"):
                self.kept.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            found = _NAME.fullmatch(name)
            if not found:
                continue
            at = {"step": int(found[1]), "direction": "backward" if found[2] else "forward", "shard": int(found[3])}
            if all(_TESTS[kind](at[column], value) for column, kind, value in self.kept):
                path = os.path.join(self.folder, name)
                rows = np.load(path, mmap_mode="r", allow_pickle=False).size
                out += [Range(path=path, start=a, stop=min(a + ROWS, rows), **at) for a in range(0, rows, ROWS)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        values = np.load(partition.path, mmap_mode="r", allow_pickle=False).reshape(-1)
        for a in range(partition.start, partition.stop, 1 << 16):
            own = np.asarray(values[a : min(a + (1 << 16), partition.stop)], np.float64)
            n = len(own)
            columns = [pa.array([partition.direction] * n), *(pa.array(np.full(n, x, np.int32)) for x in (partition.step, partition.shard)), pa.array(np.arange(a, a + n)), pa.array(own)]
            yield pa.record_batch(columns, names=["direction", "step", "shard", "row", "r2"])


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a task, whose files are its own; each file's rows must be all there, in any order."""
        os.makedirs(self.folder, exist_ok=True)
        held: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.select(["direction", "step", "shard"]).group_by(["direction", "step", "shard"]).aggregate([]).to_pylist():
                own = table
                for column, value in key.items():
                    own = own.filter(pa.compute.equal(own[column], value))
                held.setdefault(tuple(key.values()), []).append((own["row"].to_numpy(), own["r2"].to_numpy()))
        moves = []
        for (direction, step, shard), parts in held.items():
            row, value = (np.concatenate(x) for x in zip(*parts))
            if not np.array_equal(np.sort(row), np.arange(len(row))):
                raise ValueError(f"rows of {direction} {step} {shard} are not 0 to {len(row) - 1}")
            name = os.path.join(self.folder, file_name(direction, step, shard))
            if os.path.exists(name):
                raise FileExistsError(name)
            draft = os.path.join(self.folder, f".{uuid.uuid4().hex}.draft")
            with open(draft, "wb") as out:
                np.save(out, value[np.argsort(row)])
            moves.append((draft, name))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        for message in filter(None, messages):
            for draft, name in message.moves:
                os.replace(draft, name)

    def abort(self, messages: list[Written | None]) -> None:
        for message in filter(None, messages):
            for draft, _ in message.moves:
                if os.path.exists(draft):
                    os.remove(draft)


class NpyChain(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_chain"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("chains are appended to")
        return Writer(local(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyChain)


def read_chain(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy_chain").load(folder)


def write_chain(df: DataFrame, folder: str) -> None:
    """Append ``(direction, step, shard, row, r2)``, a file per direction, step and shard; rows are dealt by file."""
    register(df.sparkSession)
    rows = df.select("direction", F.col("step").cast("int").alias("step"), F.col("shard").cast("int").alias("shard"), F.col("row").cast("long").alias("row"), F.col("r2").cast("double").alias("r2"))
    rows.repartition("direction", "step", "shard").write.format("npy_chain").mode("append").save(folder)
