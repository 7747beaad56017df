"""Reporting frames: paired t-tests, verdicts, five-number summaries, tidy frames, setting effects."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varistack.functions.expressions import NAN
from varistack.sources.tables import checkpointed, dense_index

SIGNIFICANT = 0.05 / 20
#: Rows that one task sorts, about; rows of a small table that are sent to every task at most.
SORTED_ROWS, SENT_ROWS = 1 << 20, 1 << 16


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or df <= 0:
        return NAN
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(t, df)])


def paired_t(df: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """``(keys, n, mean_diff, t)`` of first - second per group; t is NaN where the differences do not vary."""
    d = F.col(first) - F.col(second)
    sums = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))).otherwise(NAN)
    return sums.select(*keys, "n", "mean_diff", t.alias("t"))


def with_verdict(tests: DataFrame, alpha: float = SIGNIFICANT) -> DataFrame:
    """Add ``p`` and ``verdict``: the second is better (lower) for t > 0, the first for t < 0, else null."""
    p = F.coalesce(t_pvalue("t", (F.col("n") - 1).cast("double")), F.lit(NAN))  # Arrow hands a NaN back as null
    tested = tests.withColumn("p", p)
    return tested.withColumn("verdict", F.when(F.isnan("p") | (F.col("p") >= alpha), None).when(F.col("t") > 0, "second").otherwise("first"))


def quantiles(df: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``(keys, q)``: exact interpolated quantiles per group, nulls left out, however large a group is.

    Rows are range-partitioned and sorted by (keys, value), in as many partitions as keep a task's share
    bounded; counts per group and partition, a small table, say where the wanted ranks lie, and only the
    rows there are kept.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    # a salt deals out equal values; ties have equal values, so their order is free
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED_ROWS))
    ranged = rows.repartitionByRange(parts, *keys, "__v", F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*keys, "__v")
    marked = checkpointed(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = marked.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*keys)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = checkpointed(sizes.withColumn("__total", F.sum("__n").over(group)))
    place = [(F.col("__total") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*[end(p) for p in place for end in (F.floor, F.ceil)]))
    wanted = sizes.select("__first", "__before", "__n", "__total", F.explode(ranks).alias("__rank")).where("__rank >= __before AND __rank < __before + __n")
    wanted = wanted.select((F.col("__first") + F.col("__rank") - F.col("__before")).alias("__at"), "__rank", "__total")
    kept = marked.join(sent(wanted), "__at")
    low = [F.max(F.when(F.col("__rank") == F.floor(p), F.col("__v"))) for p in place]
    high = [F.max(F.when(F.col("__rank") == F.ceil(p), F.col("__v"))) for p in place]
    part = [F.max(p - F.floor(p)) for p in place]
    return kept.groupBy(*keys).agg(F.array(*[a + (b - a) * w for a, b, w in zip(low, high, part)]).alias("q"))


def sent(small: DataFrame) -> DataFrame:
    """For a join: to every task, if it is small indeed, so that the other side's rows stay where they are."""
    return F.broadcast(small) if small.limit(SENT_ROWS + 1).count() <= SENT_ROWS else small


def five_number(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Box-plot summary: quartiles (interpolated), and the extreme values within 1.5 interquartile ranges."""
    box = quantiles(df, value, keys, (0.25, 0.5, 0.75))
    box = checkpointed(box.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(sent(box), list(keys)).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def tidy(df: DataFrame, keys: Sequence[str], methods: Sequence[str], value: str = "r2") -> DataFrame:
    """Wide to long: a row per method."""
    return df.unpivot(list(keys), list(methods), "method", value)


def setting_rank(df: DataFrame, setting: str) -> DataFrame:
    """Distinct setting values with their 0-based rank."""
    return dense_index(df.select(setting).distinct(), setting, name="setting_id")


def by_parameter(df: DataFrame, params: Sequence[str], aggregates: Sequence[Column], size: int = 1) -> DataFrame:
    """Aggregates over every ``size``-subset of parameters at once (grouping sets); others are null."""
    sets = [list(s) for s in combinations(params, size)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in params]).agg(*aggregates)


def absolute_errors(df: DataFrame, methods: Sequence[str], truth: str) -> DataFrame:
    """Each method's column replaced by its distance from the column ``truth``."""
    return df.withColumns({m: F.abs(F.col(m) - F.col(truth)) for m in methods})


class Frames(Mapping):
    """Frames by name, each planned when it is first asked for: one that is not pays for no step of another."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def simulation_report(results: DataFrame, setting: str, first: str = "varpar_X0_concat", second: str = "varpar_X0_stacked", truth: str = "varpar_X0_real", methods: Sequence[str] = (), alpha: float = SIGNIFICANT) -> Frames:
    """The frames of a one-factor report from a result row per run and target.

    ``tests`` has a paired test of the two estimates' absolute errors per value of ``setting``, with the
    verdict; ``errors`` the errors as a tidy frame, ``boxes`` their five numbers; ``scores`` the methods'
    values as a tidy frame.
    """
    errors = absolute_errors(results, [first, second], truth)
    long = tidy(errors.select(setting, first, second), [setting], [first, second], "error")
    names = list(methods) or [first, second]
    return Frames(
        tests=lambda: with_verdict(paired_t(errors, first, second, setting), alpha),
        errors=lambda: long,
        boxes=lambda: five_number(long, "error", setting, "method"),
        scores=lambda: tidy(results.select(setting, *names), [setting], names),
    )


def reliability(verdicts: DataFrame, params: Sequence[str], size: int = 1) -> DataFrame:
    """Per value of each parameter: settings, and those in which the second or the first estimate is better."""
    hits = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"{v}_better")
    return by_parameter(verdicts, params, [F.count("*").alias("settings"), hits("second"), hits("first")], size)
