"""Structured variance partitioning: chains of shrinking subsets of spaces, and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varistack.functions.expressions import NAN
from varistack.operators.stack import subset_scores


def chain(stats: DataFrame, f: int, *directions: str) -> DataFrame:
    """``(target_id, direction, step, r2)``: stacked R² as spaces are removed from the front or the back.

    The fits are shared by all steps: a subset needs only the weights of its block of P. One pass over
    ``stats`` scores the subsets of all steps and directions.
    """
    steps = []
    for direction in directions or ("forward",):
        if direction not in ("forward", "backward"):
            raise ValueError(f"unknown direction {direction!r}")
        steps += [(direction, step, list(range(step, f) if direction == "forward" else range(f - step))) for step in range(f)]
    scores = subset_scores(stats, f, [own for *_, own in steps])
    named = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(s).alias("step")) for d, s, _ in steps])
    return scores.select("target_id", named[F.col("subset")].alias("s"), F.col("stacked_r2").alias("r2")).select("target_id", "s.*", "r2")


def with_single_space(chains: DataFrame, singles: DataFrame, f: int) -> DataFrame:
    """Chains of steps 0 to f - 2 with the terminal step, in which one space is left.

    ``singles`` has ``(target_id, space_id, r2)``: the forward chain ends with the last space, the backward
    one with the first.
    """
    last = chains.select("target_id", "direction").distinct().withColumn("space_id", F.when(F.col("direction") == "forward", f - 1).otherwise(0))
    ends = last.join(singles.select("target_id", "space_id", "r2"), ["target_id", "space_id"])
    return chains.where(F.col("step") < f - 1).select("target_id", "direction", "step", "r2").unionByName(ends.select("target_id", "direction", F.lit(f - 1).alias("step"), "r2"))


def max_over_spaces(scores: DataFrame, value: str = "r2", first: int = 2) -> DataFrame:
    """``(target_id, max, max_all)``: the best score among the first spaces, and among all."""
    best = lambda c: F.max(c)
    return scores.groupBy("target_id").agg(best(F.when(F.col("space_id") < first, F.col(value))).alias("max"), best(F.col(value)).alias("max_all"))


def unique_variance(chains: DataFrame, *keys: str) -> DataFrame:
    """Add ``vp`` (drop of R² at the next step; the last step's own R²) and ``vp_sqrt`` (NaN for a negative drop)."""
    order = Window.partitionBy(*keys).orderBy("step")
    drop = F.col("r2") - F.coalesce(F.lead("r2").over(order), F.lit(0.0))
    return chains.withColumn("vp", drop).withColumn("vp_sqrt", F.when(F.col("vp") >= 0, F.sqrt(F.when(F.col("vp") >= 0, F.col("vp")))).otherwise(NAN))


def attribution(chains: DataFrame, *keys: str, threshold: float = 0.95, backward: bool = False) -> DataFrame:
    """``(keys, layer)``: the space whose removal first takes R² below ``threshold`` of the full R².

    NaN if the full R² is not positive; if it is NaN, or nothing falls so low, the last layer that
    the direction reaches. A NaN step never matches.
    """
    full = F.max(F.when(F.col("step") == 0, F.col("r2")))
    steps = F.max("step") + 1
    listed = chains.groupBy(*keys).agg(full.alias("full"), steps.alias("f"), F.collect_list(F.struct("step", "r2")).alias("chain"))  # one row per space
    hits = F.filter("chain", lambda s: (s["step"] > 0) & ~F.isnan(s["r2"]) & ~F.isnan(F.col("full")) & (s["r2"] < threshold * F.col("full")))
    first = F.array_min(F.transform(hits, lambda s: s["step"]))
    forward: Column = F.coalesce(first, F.col("f")).cast("double")
    layer = F.col("f") + 1 - forward if backward else forward
    return listed.select(*keys, F.when(~F.isnan("full") & (F.col("full") <= 0), NAN).otherwise(layer).alias("layer"))
