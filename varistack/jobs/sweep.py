"""Distributed parameter sweeps of the simulation experiment: one task per (setting, run), seeded by its index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistack.operators.simulate import METRICS, at_once, run_many

#: The full factorial grid.
SAMPLES = (50, 100, 200, 400)
DIMS = ((10, 10, 10, 10), (10, 100, 100, 100), (100, 100, 100, 100))
ALPHAS = ((0.3, 0.3, 0.3, 0.1), (0.5, 0.2, 0.2, 0.1), (0.7, 0.1, 0.1, 0.1))
NOISES = (0.0, 0.5, 1.0, 1.5)
CORRELS = (0.0, 0.1, 0.2, 0.3)
RUNS, SCALE, TARGETS = 50, 0.5, 2

#: The five one-factor experiments (varied setting values, then what is held).
ONE_FACTOR = {
    "Feat_Dim_ratio": {"ds": [(d, 10, 10, 10) for d in (2, 5, 10, 20, 40)], "n": 100},
    "Cond": {"alpha": [(0.1, 0.2, 0.5, 0.2), (0.3, 0.2, 0.3, 0.2), (0.5, 0.2, 0.2, 0.1), (0.7, 0.1, 0.0, 0.2), (0.9, 0.1, 0.0, 0.0)], "n": 100},
    "noise": {"noise": [0.0, 0.2, 0.5, 1.0, 1.5], "n": 100},
    "Sample_Dim_ratio": {"n": [100, 200, 400, 800], "ds": (100, 100, 100, 100)},
    "correl": {"correl": [0.0, 0.1, 0.2, 0.5, 0.8], "n": 400, "ds": (100, 100, 100, 100)},
}

RESULT = "global_index long, target_id int, " + ", ".join(f"{m} double" for m in METRICS)


def checked_alphas(alphas: Sequence[Sequence[float]]) -> None:
    """Each list of shares must sum to 1."""
    wrong = [a for a in alphas if abs(sum(a) - 1) > 1e-9]
    if wrong:
        raise ValueError(f"shares do not sum to 1: {wrong}")


def _axis(spark: SparkSession, values: Sequence, name: str, kind: str) -> DataFrame:
    return spark.createDataFrame([(i, list(v) if isinstance(v, tuple) else v) for i, v in enumerate(values)], f"i_{name} long, {name} {kind}")


def build_tasks(spark: SparkSession, samples=SAMPLES, dims=DIMS, alphas=ALPHAS, noises=NOISES, correls=CORRELS, runs: int = RUNS) -> DataFrame:
    """The full factorial of settings and runs; ``global_index`` counts with the run fastest, n slowest."""
    checked_alphas(alphas)
    axes = [
        _axis(spark, samples, "n", "int"),
        _axis(spark, dims, "ds", "array<int>"),
        _axis(spark, alphas, "alpha", "array<double>"),
        _axis(spark, noises, "noise", "double"),
        _axis(spark, correls, "correl", "double"),
        spark.range(runs).select(F.col("id").alias("i_run"), F.col("id").cast("int").alias("run")),
    ]
    sizes = [len(samples), len(dims), len(alphas), len(noises), len(correls), runs]
    names = ["n", "ds", "alpha", "noise", "correl", "run"]
    index = reduce(lambda acc, pair: acc * pair[1] + F.col(f"i_{pair[0]}"), zip(names, sizes), F.lit(0).cast("long"))
    # the axes are argument lists: the longest is dealt out, the others are broadcast
    first, *rest = sorted(axes, key=lambda a: "i_run" not in a.columns)
    return reduce(DataFrame.crossJoin, map(F.broadcast, rest), first).select(index.alias("global_index"), *names)


def shard(tasks: DataFrame, start: int, end: int) -> DataFrame:
    """Tasks with an index from ``start`` to ``end``, both included, clamped to what there is. No task at all raises."""
    last = tasks.agg(F.max("global_index")).first()[0]
    start, end = max(0, start), min(end, -1 if last is None else last)
    if start > end:
        raise ValueError("no task has an index in this range")
    return tasks.where(F.col("global_index").between(start, end))


def unnest(tasks: DataFrame, f: int = 4) -> DataFrame:
    """Lists to columns ``d1..``, ``alpha1..``."""
    lists = [F.col(c)[i].alias(f"{name}{i + 1}") for c, name in (("ds", "d"), ("alpha", "alpha")) for i in range(f)]
    return tasks.select("global_index", "n", *lists, F.col("noise").alias("sigma"), "correl", "run")


def run_tasks(tasks: DataFrame, scale: float = SCALE, targets: int = TARGETS, parts: int | None = None) -> DataFrame:
    """The metrics of each task and target; tasks are spread evenly, those of one shape that meet are run together, within bounds."""

    def run(batches):
        for pdf in batches:
            for (n, ds), own in pdf.groupby([pdf["n"], pdf["ds"].map(lambda d: tuple(map(int, d)))]):
                most = at_once(ds, targets)
                for at in range(0, len(own), most):
                    some = own.iloc[at : at + most]
                    runs = [(int(task.global_index), float(task.correl), list(task.alpha), float(task.noise)) for task in some.itertuples(index=False)]
                    got = run_many(runs, int(n), ds, scale, targets)
                    ids = {"global_index": some["global_index"].repeat(targets).to_numpy(), "target_id": list(range(targets)) * len(some)}
                    yield pd.DataFrame(ids | {name: values.ravel() for name, values in got.items()})

    spread = tasks.repartition(parts or 4 * tasks.sparkSession.sparkContext.defaultParallelism, "global_index")
    return spread.mapInPandas(run, RESULT)


def sweep(spark: SparkSession, start: int, end: int, output: str | None = None, **grid) -> DataFrame:
    """A shard of the full sweep with its settings. With ``output`` it is written there as parquet, in a folder of
    its range that a second run overwrites, and read back."""
    tasks = shard(build_tasks(spark, **grid), start, end)
    result = run_tasks(tasks).join(unnest(tasks), "global_index").withColumnRenamed("global_index", "task_index")
    if output is not None:
        result.write.mode("overwrite").parquet(f"{output}/tasks={start}-{end}")
        return spark.read.parquet(f"{output}/tasks={start}-{end}")
    return result


def one_factor_tasks(spark: SparkSession, sim_type: str, runs: int = RUNS) -> DataFrame:
    """Tasks of one of the five published experiments, with the varied setting in ``setting``."""
    if sim_type not in ONE_FACTOR:
        raise ValueError(f"unknown sim_type {sim_type!r}")
    held = {"n": 100, "ds": (10, 10, 10, 10), "alpha": (0.5, 0.2, 0.2, 0.1), "noise": 0.2, "correl": 0.2} | ONE_FACTOR[sim_type]
    varied = next(k for k, v in held.items() if isinstance(v, list))
    rows = []
    for s, value in enumerate(held[varied]):
        own = held | {varied: value}
        checked_alphas([own["alpha"]])
        setting = float(value[0]) if isinstance(value, tuple) else float(value)
        rows.append((s, setting, own["n"], list(own["ds"]), list(own["alpha"]), own["noise"], own["correl"]))
    settings = spark.createDataFrame(rows, "s long, setting double, n int, ds array<int>, alpha array<double>, noise double, correl double")
    return settings.crossJoin(spark.range(runs).withColumnRenamed("id", "run")).withColumn("global_index", F.col("s") * runs + F.col("run")).drop("s")


def one_factor(spark: SparkSession, sim_type: str, runs: int = RUNS) -> DataFrame:
    tasks = one_factor_tasks(spark, sim_type, runs)
    return run_tasks(tasks).join(tasks.select("global_index", F.col("setting").alias(sim_type), "run"), "global_index")
