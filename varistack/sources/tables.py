"""Scans and sinks: parquet tables, sharded results, and ``.npy`` arrays."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_npy(spark: SparkSession, path: str, name_pattern: str = "*.npy") -> DataFrame:
    """``(path, row, values)``: the rows of every 1-d or 2-d ``.npy`` file below a path, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.load(io.BytesIO(content), allow_pickle=False).squeeze().astype(np.float64)
                rows = np.atleast_2d(rows)
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    yield pa.record_batch([pa.array([file] * len(own)), pa.array(range(at, at + len(own)), pa.int64()), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["path", "row", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", name_pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, values array<double>")


def write_results(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append results as parquet, partitioned so that later reads prune (steps, shards, settings)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """``(direction, step, shard, target_id, r2)`` of a chain written by :func:`write_results` with the first
    three as partitions: filters on them prune files. A missing partition column raises."""
    rows = spark.read.parquet(path)
    missing = {"direction", "step", "shard", "target_id", "r2"} - set(rows.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)} in the chain")
    return rows.select("direction", F.col("step").cast("int").alias("step"), "shard", "target_id", "r2")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it names none, a temporary folder serves local mode; on a cluster that raises, as the executors
    would not see the driver's folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, on whatever file system it is; one that is not there stays so."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dense_index(df: DataFrame, *order: str, name: str = "t") -> DataFrame:
    """Add a dense 0-based position in the total order of ``order``, without a single-partition sort.

    Rows are range-partitioned and sorted; each partition's offset is the number of rows before it,
    a table of one row per partition. The ranges come from a sample, so they are fixed by a checkpoint
    before the rows are counted.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ranged.withColumn("__id", F.monotonically_increasing_id())
    local = local.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    local = checkpointed(local)
    counts = local.groupBy("__part").agg(F.count("*").alias("n")).collect()  # a row per partition
    offset, pairs = 0, []
    for part, n in sorted(map(tuple, counts)):
        pairs.append((part, offset))
        offset += n
    offsets = df.sparkSession.createDataFrame(pairs, "__part long, __offset long")
    return local.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__id", "__at", "__offset")
