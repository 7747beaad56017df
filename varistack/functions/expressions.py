"""Column expressions: folds, z-scores and scores, with defined results for constants and NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308
NAN = float("nan")


def fold_last(t: Column, n: Column, k: int) -> Column:
    """Contiguous folds of floor(n / k) rows; the remainder goes to the last. Fewer rows than folds raise."""
    size = F.floor(n / F.lit(k))
    return F.when(size == 0, F.raise_error(F.lit("fewer rows than folds")).cast("long")).otherwise(F.least(F.floor(t / F.greatest(size, F.lit(1))), F.lit(k - 1))).cast("long")


def fold_first(t: Column, n: Column, k: int) -> Column:
    """Contiguous folds; the remainder is spread over the first ones."""
    size, more = F.floor(n / F.lit(k)), n % F.lit(k)
    edge = more * (size + 1)
    return F.when(t < edge, F.floor(t / (size + 1))).otherwise(more + F.floor((t - edge) / F.greatest(size, F.lit(1)))).cast("long")


def nan_to_num(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), LARGEST).when(x == float("-inf"), -LARGEST).otherwise(x)


def group_zscore(df: DataFrame, column: str, keys: Sequence[str], name: str = "z", clean: bool = True) -> DataFrame:
    """Add the population z-score of a column within its group. A column that is constant or holds a NaN or
    an infinity there becomes 0 (``clean``) or NaN.

    A row of statistics per group is joined back, so that no group is gathered in one task.
    """
    x = F.col(column).cast("double")
    stats = df.groupBy(*keys).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd"), (F.min(x) < F.max(x)).alias("__varies"))
    usable = F.col("__varies") & ~F.isnan("__sd") & (F.col("__sd") > 0)
    z = F.when(usable, (x - F.col("__mean")) / F.when(F.col("__sd") > 0, F.col("__sd"))).otherwise(0.0 if clean else NAN)
    return df.join(stats, list(keys)).withColumn(name, z).drop("__mean", "__sd", "__varies")


def r2_of(ss_mean: Column, variance: Column) -> Column:
    """1 - ss / var; with no variance 0 for a perfect prediction, else the lowest double; NaN becomes 0."""
    ratio = ss_mean / F.when(variance != 0, variance)
    value = F.when(variance == 0, F.when(ss_mean == 0, 0.0).otherwise(-LARGEST)).otherwise(1.0 - ratio)
    return F.nanvl(value, F.lit(0.0))


def r2(pred: Column, real: Column) -> Column:
    """Coefficient of determination, as an aggregate."""
    return r2_of(F.avg((real - pred) * (real - pred)), F.var_pop(real))


def r2_root(value: Column) -> Column:
    return F.signum(value) * F.sqrt(F.abs(value))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NaN if either side is constant."""
    usable = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    covariance = F.covar_pop(x, y)
    return F.when(usable, covariance / F.when(usable, F.stddev_pop(x) * F.stddev_pop(y))).otherwise(NAN)


def register(spark: SparkSession) -> None:
    """Make the scalar expressions callable from SQL as temporary functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION r2_root(v DOUBLE) RETURNS DOUBLE RETURN signum(v) * sqrt(abs(v))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fold_last(t BIGINT, n BIGINT, k BIGINT) RETURNS BIGINT RETURN CASE WHEN n < k THEN raise_error('fewer rows than folds') ELSE least(t div (n div k), k - 1) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fold_ntile(t BIGINT, n BIGINT, k BIGINT) RETURNS BIGINT RETURN CASE WHEN t < (n % k) * (n div k + 1) THEN t div (n div k + 1) ELSE n % k + (t - (n % k) * (n div k + 1)) div greatest(n div k, 1) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION r2(ss_mean DOUBLE, variance DOUBLE) RETURNS DOUBLE RETURN CASE WHEN variance = 0 THEN IF(ss_mean = 0, 0D, -{LARGEST!r}D) ELSE nanvl(1 - ss_mean / variance, 0D) END")
