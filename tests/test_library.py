import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varistack.functions import expressions as E
from varistack.jobs import report, sweep
from varistack.jobs.queries import ORACLE_SQL, QUERIES
from varistack.operators import simulate
from varistack.sources import tables
from varistack.streaming import moments

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "events", "lineitem", "embeddings", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def plain(df: pd.DataFrame):
        df = df[sorted(df.columns)].map(lambda x: tuple(map(float, x)) if isinstance(x, (list, np.ndarray)) else str(x)[:10] if hasattr(x, "year") else x)
        return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))

    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = [c for c in want.columns if want[c].dtype == float]
    for df in (got, want):
        df[numbers] = df[numbers].astype(float).round(5) + 0.0
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"sweep_run"}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("n", "k"), [(10, 4), (101, 10), (9, 3)])
def test_folds(spark, n, k):
    t = spark.range(n).select(F.col("id").alias("t"), E.fold_last(F.col("id"), F.lit(n), k).alias("a"), E.fold_first(F.col("id"), F.lit(n), k).alias("b")).orderBy("t").collect()
    assert [r.a for r in t] == oracle.last_folds(n, k).tolist()
    assert [r.b for r in t] == oracle.first_folds(n, k).tolist()


def test_registered_functions(spark):
    E.register(spark)
    row = spark.sql("select r2_root(-0.25D) a, fold_last(9L, 10L, 4L) b, r2(1D, 4D) c, r2(1D, 0D) d, r2(0D, 0D) e").first()
    assert tuple(row) == (-0.5, 3, 0.75, -E.LARGEST, 0.0)
    folds = spark.range(11).selectExpr("fold_ntile(id, 11L, 4L) f").collect()
    assert [r.f for r in folds] == oracle.first_folds(11, 4).tolist()
    with pytest.raises(Exception, match="fewer rows than folds"):
        spark.sql("select fold_last(1L, 3L, 5L)").collect()
    with pytest.raises(Exception, match="fewer rows than folds"):
        spark.range(3).select(E.fold_last(F.col("id"), F.lit(3), 5)).collect()


def test_scores_of_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "p double, y double")
    row = df.agg(E.r2(F.col("p"), F.col("y")), E.r2(F.col("y"), F.col("y")), E.corr(F.col("p"), F.col("y"))).first()
    assert row[0] == -E.LARGEST and row[1] == 0.0 and math.isnan(row[2])
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in odd.select(E.nan_to_num(F.col("x"))).collect()] == [0.0, E.LARGEST, -E.LARGEST, 2.0]


def test_dense_index(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 7919 % 100_003).alias("k")).repartition(5)
    got = tables.dense_index(df, "k").orderBy("k").collect()
    assert [r.t for r in got] == list(range(len(got)))


def test_npy_source(spark, tmp_path):
    np.save(tmp_path / "a_1.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "a_2.npy", np.arange(3))
    got = {(r.path.rsplit("/", 1)[1], r.row): r["values"] for r in tables.read_npy(spark, str(tmp_path)).collect()}
    assert got == {("a_1.npy", 0): [0, 1, 2], ("a_1.npy", 1): [3, 4, 5], ("a_2.npy", 0): [0, 1, 2]}


def test_t_distribution():
    for t, df, p in ((2.0, 10, 0.07338803), (0.5, 3, 0.65145), (-3.5, 49, 0.00100148), (12.706205, 1, 0.05)):
        assert abs(report.t_two_sided(t, df) - p) < 1e-5
    assert math.isnan(report.t_two_sided(float("nan"), 5)) and report.t_two_sided(0.0, 5) == 1.0


def test_verdicts(spark):
    rows = [("a", float(i), float(i) - 1 - i % 3 * 0.1) for i in range(30)] + [("b", 1.0, 2.0)] * 5 + [("c", float(i % 2), 0.5) for i in range(10)]
    got = {r.g: (r.verdict, r.p) for r in report.with_verdict(report.paired_t(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g")).collect()}
    assert got["a"][0] == "second" and got["b"][0] is None and math.isnan(got["b"][1]) and got["c"][0] is None


def test_sweep_tasks(spark):
    tasks = sweep.build_tasks(spark)
    assert tasks.count() == 28_800 and tasks.select("global_index").distinct().count() == 28_800
    first = tasks.where("global_index in (0, 1, 50, 28799)").orderBy("global_index").collect()
    assert [(r.n, r.run, r.correl) for r in first] == [(50, 0, 0.0), (50, 1, 0.0), (50, 0, 0.1), (400, 49, 0.3)]
    assert sweep.shard(tasks, -5, 9).count() == 10
    with pytest.raises(ValueError):
        sweep.shard(tasks, 5, 4)
    with pytest.raises(ValueError):
        sweep.shard(tasks, 28_800, 28_900)
    with pytest.raises(ValueError):
        sweep.build_tasks(spark, alphas=((0.5, 0.4, 0.2, 0.1),))
    assert sweep.unnest(tasks).columns == ["global_index", "n", "d1", "d2", "d3", "d4", "alpha1", "alpha2", "alpha3", "alpha4", "sigma", "correl", "run"]
    assert [sweep.one_factor_tasks(spark, s).count() for s in sweep.ONE_FACTOR] == [250, 250, 250, 200, 250]
    with pytest.raises(ValueError):
        sweep.one_factor_tasks(spark, "other")


def test_simulation(spark, tmp_path):
    xs, y, real = simulate.sample(np.random.RandomState(1), 400, [3, 3], 0.5, 0.0, [0.8, 0.2], 2)
    assert [x.shape for x in xs] == [(400, 3)] * 2 and np.allclose(y.std(0), 1) and (real[0] > real[1]).all()
    a, b = (simulate.run_one(7, 60, [3, 2], 0.5, 0.2, [0.7, 0.3], 2, 0.5) for _ in range(2))
    assert list(a) == list(simulate.METRICS) and all(np.array_equal(a[k], b[k]) for k in a)
    assert (a["stacked"] <= 1).all() and ((a["weight_0"] >= 0) & (a["weight_0"] <= 1)).all()
    small = {"samples": (40,), "dims": ((2, 2, 2, 2),), "alphas": ((0.4, 0.3, 0.2, 0.1),), "noises": (0.0,), "correls": (0.0, 0.1), "runs": 2}
    out = sweep.sweep(spark, 1, 2, str(tmp_path / "sweep"), **small)
    assert spark.read.parquet(str(tmp_path / "sweep")).count() == out.count() == 4
    again = sweep.sweep(spark, 1, 2, str(tmp_path / "sweep"), **small)
    assert again.count() == spark.read.parquet(str(tmp_path / "sweep")).count() == 4
    frames = report.simulation_report(again, "correl")
    assert frames["tests"].count() == 2 and frames["errors"].count() == 8 and frames["boxes"].count() == 4


def test_stack_inside_a_simulation_matches_rows():
    rng = np.random.RandomState(3)
    xs, y, _ = simulate.sample(rng, 80, [3, 2], 0.5, 0.1, [0.7, 0.3], 2, 0.5)
    got = simulate.run_one(3, 80, [3, 2], 0.5, 0.1, [0.7, 0.3], 2, 0.5)
    each, stacked, *_ = oracle.stack_cv(xs, oracle.z(y), 4)
    assert np.allclose(got["r2_X0"], each[0], atol=1e-6) and np.allclose(got["stacked"], stacked, atol=2e-3)
    assert np.allclose(got["max"], each.max(0), atol=1e-6)


def test_streamed_moments(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("a"), (F.col("id") * 2 + 1).cast("double").alias("b"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        moments.accumulate(stream, ["g"], ["a", "b"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.g: r.asDict() for r in moments.merged(spark.read.parquet(str(tmp_path / "out")), ["g"]).collect()}
    want = {r.g: r.asDict() for r in moments.sums(rows, ["g"], ["a", "b"]).collect()}
    assert got == want


def test_reports(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)] + [(0, 500.0)], "g long, v double")
    box = {r.g: r for r in report.five_number(df, "v", "g").collect()}
    assert box[0].high == 18.0 and box[1].median == 10.0
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "k long, stacked double, concat double")
    assert {(r.method, r.r2) for r in report.tidy(wide, ["k"], ["stacked", "concat"]).collect()} == {("stacked", 0.1), ("concat", 0.2)}


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_of_groups(spark, parts):
    """Ties, nulls, a null key and a hot group against NumPy."""
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 900), ("b", 3), ("c", 1), (None, 40)) for v in rng.integers(0, 9, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r.g: r.q for r in report.quantiles(df, "v", ["g"], (0.25, 0.5, 0.9)).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], (0.25, 0.5, 0.9)))
    assert "d" not in got


def test_chain_reader(spark, tmp_path):
    rows = [("forward", s, i, t, 1.0 - 0.1 * s) for s in range(2) for i in range(2) for t in range(3)]
    tables.write_results(spark.createDataFrame(rows, "direction string, step int, shard int, target_id int, r2 double"), str(tmp_path / "chain"), "direction", "step", "shard")
    got = tables.read_chain(spark, str(tmp_path / "chain"))
    assert got.count() == 12 and "PartitionFilters: [" in got.where("step = 1")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(str(tmp_path / "other"))
        tables.read_chain(spark, str(tmp_path / "other"))


def jobs_of(spark, ask) -> int:
    """How many jobs a call starts."""
    spark.sparkContext.setJobGroup("asked", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("asked"))
    ask()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("asked"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return after - before


@pytest.mark.parametrize("name", ["scores", "tests"])
def test_a_frame_of_the_report_pays_for_no_other(spark, name):
    rows = spark.createDataFrame([(i % 3, float(i), float(i % 5), 1.0) for i in range(60)], "s long, a double, b double, c double")
    frames = report.simulation_report(rows, "s", "a", "b", "c")
    assert list(frames) == ["tests", "errors", "boxes", "scores"] and len(frames) == 4
    assert jobs_of(spark, lambda: report.simulation_report(rows, "s", "a", "b", "c")[name]) == 0
    assert frames[name].count() == {"scores": 120, "tests": 3}[name]


def test_a_task_of_the_quantiles_sorts_a_bounded_share(spark, monkeypatch):
    """More rows make more partitions, of any number of groups; places are few and are sent, or joined."""
    made, keep = [], report.checkpointed
    monkeypatch.setattr(report, "checkpointed", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(report, "SORTED_ROWS", 500)
    rows = spark.range(10_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    values = rows.toPandas()
    for most in (1 << 16, 2):
        monkeypatch.setattr(report, "SENT_ROWS", most)
        made.clear()
        got = {r.g: r.q for r in report.quantiles(rows, "v", ["g"], (0.1, 0.5)).collect()}
        sizes = made[0].groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(sizes) > 15 and sizes.max() < 1_500
        assert all(np.allclose(got[g], np.quantile(own["v"], (0.1, 0.5))) for g, own in values.groupby("g"))
    box = {r.g: r for r in report.five_number(rows, "v", "g").collect()}
    assert box[1].low == values[values.g == 1].v.min() and box[1].high == values[values.g == 1].v.max()
