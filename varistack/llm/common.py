"""Helpers shared by the operators: tables, checkpoints, Arrow slices, graph components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistack.sources.tables import checkpointed, shared_folder

#: Bytes of text that one slice of an Arrow batch holds at most (a single longer row makes its own slice).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; see :func:`shared_dir`."""
    return checkpointed(df)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode may the session leave it unset."""
    return shared_folder(spark)


def give_back() -> None:
    """Hand memory that is free back to the system: Python workers stay for later stages, with what their heaps hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove shuffle files and checkpoints that nothing refers to any more.

    It removes them once the driver's JVM has collected its garbage, which may be never in a job whose
    driver only plans: many rounds would leave the files of all of them on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 0) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each part holds at most ``most`` (``SLICE_BYTES``) bytes of ``column``.

    Batches come by row count; without this, long texts would set the memory that a task needs.
    """
    import numpy as np
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        part = np.cumsum(size.astype(np.int64)) // (most or SLICE_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def map_text(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` with ``func`` applied to memory-bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield func(part)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``, component = smallest node.

    Alternates large-star and small-star steps, each a groupBy-min and an equi-join on edges, until
    the edge set stops changing; O(log^2 n) rounds, each cut by a reliable checkpoint. Neighbour lists
    are never collected, so a hot node costs rows of a join that Spark can split, not one task's
    memory. Self loops and nulls are ignored; an isolated node has no row.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    e = checkpoint(e)
    before = None
    while True:
        e = checkpoint(_starred(e))
        let_go(edges.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)


def _starred(e: DataFrame) -> DataFrame:
    """The edges ``(u, v)``, u > v, after a large-star and a small-star step."""
    both = e.union(e.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
    return small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
