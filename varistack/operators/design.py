"""Designs whose feature spaces live in tables of their own.

Each table has a row per position ``t``. Written in buckets of ``t`` once, tables join without another
shuffle, however often a design is read: a bucket of each is sorted and merged in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistack.sources.tables import remove_folder, shared_folder


def bucketed(df: DataFrame, buckets: int, key: str = "t", name: str | None = None) -> DataFrame:
    """The rows as a table in ``buckets`` buckets of ``key``, one sorted file each, under the shared folder.

    Tables to be joined need the same number of buckets. The table is one of the session's catalog;
    :func:`drop` removes it.
    """
    spark = df.sparkSession
    name = name or f"space_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)  # the buckets' own hash: one file a bucket
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, *names: str) -> None:
    """Remove tables of :func:`bucketed` from the catalog, and their files."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, f"{shared_folder(spark)}/{name}")


def _numbers(column: str):
    return F.transform(F.col(column).cast("array<double>"), lambda e: F.coalesce(e, F.lit(float("nan"))))


def check_aligned(tables: Sequence[DataFrame], columns: Sequence[str]) -> tuple[int, list[int]]:
    """``(rows, widths)`` of tables with the same dense 0-based ``t``, each with arrays of one width.

    Anything else raises: positions that are missing, double or beyond, and rows of unequal width.
    """
    n, widths = None, []
    for table, column in zip(tables, columns):
        size = F.size(F.coalesce(F.col(column), F.array().cast("array<double>")))
        rows, low, high, narrow, wide, mass = table.agg(F.count("*"), F.min("t"), F.max("t"), F.min(size), F.max(size), F.sum(F.col("t").cast("decimal(38,0)"))).first()
        if not rows or low != 0 or high != rows - 1 or mass != rows * (rows - 1) // 2:
            raise ValueError("t must be dense and 0-based in every table")
        if n is not None and rows != n:
            raise ValueError(f"tables of {n} and {rows} rows")
        if narrow != wide or not wide:
            raise ValueError(f"rows of {narrow} to {wide} values in {column}")
        n, widths = rows, [*widths, wide]
    return n, widths


def from_spaces(spaces: Sequence[DataFrame], targets: DataFrame) -> tuple[DataFrame, list[int]]:
    """``(design, dims)`` of tables ``(t, x)``, one per feature space in order, and ``(t, y)``.

    The design has ``t``, ``x`` (the spaces side by side) and ``y``, for all fits of ``stack``. Tables from
    :func:`bucketed` with one number of buckets are merged in place; others are shuffled by ``t`` first.
    Nulls become NaN, whose columns count as dead. Other columns are ignored.
    """
    _, widths = check_aligned([*spaces, targets], ["x"] * len(spaces) + ["y"])
    joined = targets.select("t", _numbers("y").alias("y"))
    for i, space in enumerate(spaces):
        joined = joined.hint("merge").join(space.select("t", _numbers("x").alias(f"x{i}")), "t")
    x = F.concat(*[F.col(f"x{i}") for i in range(len(spaces))])
    return joined.select(F.col("t").cast("long").alias("t"), x.alias("x"), "y"), widths[:-1]
