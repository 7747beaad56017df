"""Moments of a growing table: each micro-batch adds its partial sums, and any state gives the statistics so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mergeable sums per group: count, sum and cross products of the columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs],
    )


def accumulate(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write the sums of each micro-batch under its id; a repeated batch overwrites its own, so none counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sums(batch, keys, columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum the batches' sums."""
    values = [c for c in parts.columns if c not in (*keys, "batch")]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])
