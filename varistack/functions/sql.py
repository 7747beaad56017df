"""The library's functions by name in SQL text.

``register`` adds, besides the scalar ones of :mod:`expressions`: ``simplex_weights(array)``, the weights of
a flattened quadratic form; ``t_pvalue(t, df)``; and the table functions ``fold_bounds(n, k)`` (remainder in the
last fold) and ``fold_bounds_ntile(n, k)`` (spread over the first). SQL functions cannot aggregate: ``r2`` takes
two built-in aggregates, ``r2(avg(pow(real - pred, 2)), var_pop(real))``, which Spark sums up before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from varistack.functions import expressions
from varistack.jobs.report import t_pvalue
from varistack.operators.qp import simplex_udf

_FEW = "raise_error('fewer rows than folds')"
_FOLDS = f"(SELECT explode(CASE WHEN k < 1 OR n < k THEN {_FEW} ELSE sequence(0L, k - 1) END) AS f)"


def register(spark: SparkSession) -> None:
    expressions.register(spark)
    spark.udf.register("simplex_weights", simplex_udf)
    spark.udf.register("t_pvalue", t_pvalue)
    table = "CREATE OR REPLACE TEMPORARY FUNCTION {}(n BIGINT, k BIGINT) RETURNS TABLE(fold BIGINT, start BIGINT, stop BIGINT) RETURN SELECT {} FROM " + _FOLDS
    spark.sql(table.format("fold_bounds", "f, f * (n div k), CASE WHEN f = k - 1 THEN n ELSE (f + 1) * (n div k) END"))
    spark.sql(table.format("fold_bounds_ntile", "f, f * (n div k) + least(f, n % k), (f + 1) * (n div k) + least(f + 1, n % k)"))
