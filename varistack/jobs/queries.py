"""The registered queries of the regression library, each with SQL where SQL can say it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varistack.functions import expressions as E
from varistack.functions import sql
from varistack.functions.scores import Correlation
from varistack.jobs import report, sweep
from varistack.operators import concat, design, moments, predict, stack, varpart
from varistack.operators.qp import simplex_two
from varistack.operators.ridge import SOLVERS
from varistack.sources import npy
from varistack.sources.tables import dense_index, read_chain, shared_folder, table, write_results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLE_SQL[func.__name__] = sql
        return func

    return add


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else (F.round(c, DIGITS) + 0.0).alias(c) for c in df.columns])


# ---------------------------------------------------------------- fixtures

PART = """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS t, p_size::DOUBLE AS x1, (p_partkey * 7919 % 1000)::DOUBLE AS x2,
  (p_partkey * 104729 % 1009)::DOUBLE AS x3, 0.06e0 * p_size + 0.002e0 * (p_partkey * 7919 % 1000) + 0.001e0 * (p_partkey * 104729 % 1009) AS y FROM part"""


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t, x1, x2, x3, y)`` planted on ``part``: y is a weighted sum of the three."""
    p = dense_index(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    x2, x3 = F.col("p_partkey") * 7919 % 1000, F.col("p_partkey") * 104729 % 1009
    y = 0.06 * F.col("p_size") + 0.002 * x2 + 0.001 * x3
    return p.select("t", F.col("p_size").cast("double").alias("x1"), x2.cast("double").alias("x2"), x3.cast("double").alias("x3"), y.alias("y"))


def part_design(spark: SparkSession, sf_dir: str, spaces: int = 2) -> DataFrame:
    return stack.pack(part_rows(spark, sf_dir), "t", [[F.col(f"x{i + 1}")] for i in range(spaces)], [F.col("y")])


def embedding_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spaces of 16 dimensions, eight targets mixed .5 / .2 / .2 / .1 from them."""
    e = dense_index(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id")
    at = lambda v, s: F.col("e")[v + 16 * s]
    ys = [0.5 * at(v, 0) + 0.2 * at(v, 1) + 0.2 * at(v, 2) + 0.1 * at(v, 3) for v in range(8)]
    return stack.pack(e, "t", [F.slice("e", 16 * s + 1, 16) for s in range(4)], ys)


DIMS = [16, 16, 16, 16]


def nested_sql(final: str, spaces: int = 2, folds: int = 4, train_share: float | None = None, method: str = "cross_val_ridge", base: str = PART) -> str:
    """Nested cross-validated ridge and two-space stack weights for scalar spaces, as one statement.

    With one z-scored predictor the weight is n r / (n + λ) and the cost 1 - 2 w r_val + w².
    """
    fold = f"least(t // (n // {folds}), {folds - 1})" if train_share is None else f"CASE WHEN t < floor({train_share}e0 * n) THEN 1 ELSE 0 END"
    long = " UNION ALL ".join(f"SELECT t, y, n, {s} AS s, x{s} AS x, {fold} AS fold FROM base, nn" for s in range(1, spaces + 1))
    weight = "n * r / (n + lam)" if method == "cross_val_ridge" else "CASE WHEN b < 0 THEN n * r / (n + lam) ELSE n0 * r0 / (n0 + 100.0e0) END"
    return f"""WITH base AS ({base}), nn AS (SELECT count(*) AS n FROM base),
    long AS ({long}),
    tr AS (SELECT k, s, t, x, y, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY k, s) AS ntr, ntile(5) OVER w - 1 AS c0,
        (y - avg(y) OVER p) / stddev_pop(y) OVER p AS yz
      FROM long, range({1 if train_share else folds}) o(k) WHERE fold <> k WINDOW w AS (PARTITION BY k, s ORDER BY t), p AS (PARTITION BY k, s)),
    trb AS (SELECT *, least(pos // (ntr // 5), 4) AS own FROM tr),
    rows AS (SELECT k, -1 AS b, s, t, x, y, c0 AS c FROM trb UNION ALL
      SELECT k, b, s, t, x, y, ntile(5) OVER (PARTITION BY k, b, s ORDER BY t) - 1 AS c FROM trb, range(5) i(b) WHERE own <> b),
    splits AS (SELECT k, b, s, cc, corr(x, y) FILTER (c <> cc) AS rt, count(*) FILTER (c <> cc) AS nt, corr(x, y) FILTER (c = cc) AS rv
      FROM rows, range(5) q(cc) GROUP BY ALL),
    grid AS (SELECT i, pow(10.0e0, i - 6) AS lam FROM range(16) g(i)),
    cost AS (SELECT k, b, s, i, lam, sum(1 - 2 * (nt * rt / (nt + lam)) * rv + pow(nt * rt / (nt + lam), 2)) AS cost FROM splits, grid GROUP BY ALL),
    best AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY k, b, s ORDER BY cost, i) = 1),
    whole AS (SELECT k, b, s, corr(x, y) AS r, count(*) AS n FROM rows GROUP BY ALL),
    outerw AS (SELECT k, s, r AS r0, n AS n0 FROM whole WHERE b = -1),
    fits AS (SELECT k, b, s, {weight} AS w FROM best JOIN whole USING (k, b, s) JOIN outerw USING (k, s)),
    oof AS (SELECT t.k, t.s, t.t, yz, w * (x - avg(x) OVER v) / stddev_pop(x) OVER v AS pred
      FROM trb t JOIN fits f ON f.k = t.k AND f.s = t.s AND f.b = t.own WINDOW v AS (PARTITION BY t.k, t.s, t.own)),
    err AS (SELECT k, s, t, yz - pred AS e FROM oof),
    pmat AS (SELECT a.k, a.s AS i, b.s AS j, avg(a.e * b.e) AS p FROM err a JOIN err b ON a.k = b.k AND a.t = b.t GROUP BY ALL),
    p2 AS (SELECT k, max(p) FILTER (i = 1 AND j = 1) AS p11, max(p) FILTER (i = 1 AND j = 2) AS p12, max(p) FILTER (i = 2 AND j = 2) AS p22 FROM pmat GROUP BY k),
    sw AS (SELECT *, greatest(0e0, least(1e0, (p22 - p12) / (p11 + p22 - 2 * p12))) AS w1 FROM p2),
    test AS (SELECT l.fold AS k, l.s, l.t, w * (x - avg(x) OVER v) / stddev_pop(x) OVER v AS pred, y,
        {"(y - avg(y) OVER v) / stddev_pop(y) OVER v" if train_share else "NULL"} AS yt
      FROM long l JOIN fits f ON f.k = l.fold AND f.s = l.s AND f.b = -1 WINDOW v AS (PARTITION BY l.fold, l.s)),
    whole_z AS (SELECT t, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS yg FROM base),
    pooled AS (SELECT k, s, t, pred, coalesce(yt, yg) AS yg, CASE WHEN s = 1 THEN w1 ELSE 1 - w1 END AS sw FROM test JOIN whole_z USING (t) JOIN sw USING (k)),
    stacked AS (SELECT t, any_value(yg) AS yg, sum(pred * sw) AS pred FROM pooled GROUP BY t)
    {final}"""


SPACE_FINAL = """, a AS (SELECT s, 1 - avg(pow(yg - pred, 2)) / var_pop(yg) AS r2, 1 - avg(pow(yg - sw * pred, 2)) / var_pop(yg) AS r2_weighted FROM pooled GROUP BY s),
    b AS (SELECT i AS s, avg(1 - p) AS r2_train FROM pmat WHERE i = j GROUP BY i),
    c AS (SELECT s, avg(sw) AS weight FROM (SELECT DISTINCT k, s, sw FROM pooled) GROUP BY s)
    SELECT 0::INT AS target_id, (s - 1)::INT AS space_id, round(r2, 6) + 0.0e0 AS r2, round(r2_weighted, 6) + 0.0e0 AS r2_weighted, round(r2_train, 6) + 0.0e0 AS r2_train, round(weight, 6) + 0.0e0 AS weight
    FROM a JOIN b USING (s) JOIN c USING (s)"""
TARGET_FINAL = """SELECT 0::INT AS target_id, round((SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM stacked), 6) + 0.0e0 AS stacked_r2,
    round((SELECT avg(1 - (w1 * w1 * p11 + 2 * w1 * (1 - w1) * p12 + (1 - w1) * (1 - w1) * p22)) FROM sw), 6) + 0.0e0 AS stacked_train_r2"""


# ---------------------------------------------------------------- folds, z-scores, masks


@query(f"WITH b AS ({PART}), n AS (SELECT count(*) AS n FROM b) SELECT t, least(t // (n // 4), 3)::BIGINT AS fold FROM b, n")
def fold_last(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("t", E.fold_last(F.col("t"), F.col("n"), 4).alias("fold"))


@query("SELECT event_id, (ntile(7) OVER (ORDER BY event_id) - 1)::BIGINT AS fold FROM events")
def fold_ntile(spark, sf_dir):
    rows = dense_index(table(spark, sf_dir, "events").select("event_id"), "event_id")
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("event_id", E.fold_first(F.col("t"), F.col("n"), 7).alias("fold"))


def _global_z(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """z-scores over a whole table: one row of statistics is joined back, nothing is gathered."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("sd"))
    return df.crossJoin(F.broadcast(stats)).select(*keys, (F.round((F.col(column) - F.col("m")) / F.col("sd"), DIGITS) + 0.0).alias("z"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0e0 AS z FROM orders")
def zscore_global(spark, sf_dir):
    return _global_z(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice")


@query(f"""WITH b AS ({PART}), f AS (SELECT *, least(t // ((SELECT count(*) FROM b) // 4), 3) AS fold FROM b)
SELECT t, fold::BIGINT AS fold, round((x1 - avg(x1) OVER w) / stddev_pop(x1) OVER w, 6) + 0.0e0 AS z FROM f WINDOW w AS (PARTITION BY fold)""")
def zscore_by_fold(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))
    folded = rows.crossJoin(F.broadcast(n)).withColumn("fold", E.fold_last(F.col("t"), F.col("n"), 4))
    stats = folded.groupBy("fold").agg(F.avg("x1").alias("m"), F.stddev_pop("x1").alias("sd"))
    return folded.join(F.broadcast(stats), "fold").select("t", "fold", (F.round((F.col("x1") - F.col("m")) / F.col("sd"), DIGITS) + 0.0).alias("z"))


@query("SELECT p_partkey, p_size % 3 AS g, 0.0e0 AS z, 0.0e0 AS with_nan FROM part")
def zscore_constant_column(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("g"))
    first = p.groupBy("g").agg(F.min("p_partkey").alias("low"))
    bad = F.when(F.col("p_partkey") == F.col("low"), float("nan")).otherwise(F.col("p_partkey").cast("double"))
    spoiled = p.join(first, "g").withColumn("bad", bad).withColumn("same", F.lit(0.1))
    both = E.group_zscore(E.group_zscore(spoiled, "same", ["g"]), "bad", ["g"], "with_nan")
    return both.select("p_partkey", "g", "z", "with_nan")


@query("SELECT o_orderkey, (o_orderkey % 5 <> 2) AS train FROM orders WHERE o_orderkey % 5 <> 2 OR o_totalprice > 1000")
def train_test_mask(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderkey % 5 <> 2 OR o_totalprice > 1000").select("o_orderkey", (F.col("o_orderkey") % 5 != 2).alias("train"))


# ---------------------------------------------------------------- scores and moments


@query("""SELECT l_returnflag, round(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice), 6) + 0.0e0 AS r2,
 round(sign(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice)) * sqrt(abs(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice))), 6) + 0.0e0 AS r2_root
 FROM lineitem GROUP BY l_returnflag""")
def r2_score(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(E.r2(1500.0 * F.col("l_quantity"), F.col("l_extendedprice")).alias("r2"))
    return rounded(scored.withColumn("r2_root", E.r2_root(F.col("r2"))), "l_returnflag")


@query("SELECT l_returnflag, -1.7976931348623157e308 AS missed, 0.0e0 AS met FROM lineitem GROUP BY l_returnflag")
def r2_constant_real(spark, sf_dir):
    five = F.lit(5.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(E.r2(F.col("l_quantity"), five).alias("missed"), E.r2(five, five).alias("met"))


@query("SELECT l_shipdate::DATE AS day, round(corr(l_quantity, l_extendedprice), 6) + 0.0e0 AS corr FROM lineitem GROUP BY 1 HAVING var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0")
def corr_by_group(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return rounded(g.agg(E.corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("corr")).where(~F.isnan("corr")), "day")


@query("SELECT event_type, round(var_pop(value), 4) + 0.0e0 AS var, round(avg(value), 6) + 0.0e0 AS mean FROM events GROUP BY event_type")
def var_pop_by_group(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type")
    return g.agg((F.round(F.var_pop("value"), 4) + 0.0).alias("var"), (F.round(F.avg("value"), 6) + 0.0).alias("mean"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS i FROM embeddings)
SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0e0 AS g FROM e a JOIN e b USING (vec_id) GROUP BY ALL""")
def gram_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("t"), F.col("embedding").cast("array<double>").alias("x"))
    return moments.gram(e, DIMS).select("i", "j", (F.round("g", 4) + 0.0).alias("g"))


@query("""SELECT l_linenumber AS seg, count(*) AS n, round(sum(l_quantity), 2) + 0.0e0 AS s, round(sum(l_quantity * l_discount), 2) + 0.0e0 AS sxy, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem GROUP BY l_linenumber""")
def moment_segments(spark, sf_dir):
    """Segments of the rows in the order of their line number: quantity as predictor, discount as target."""
    lines = dense_index(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity", "l_discount"), "l_linenumber", "l_orderkey")
    sizes = sorted(map(tuple, lines.groupBy("l_linenumber").agg(F.count("*")).collect()))  # a row per line number
    starts = np.cumsum([0, *[n for _, n in sizes[:-1]]])
    design = stack.pack(lines, "t", [[F.col("l_quantity")]], [F.col("l_discount")])
    rows = moments.segment_moments(design, starts, np.zeros(2), [np.array([0])], 1, 1)
    named = F.array(*[F.lit(k) for k, _ in sizes])[F.col("seg")]
    sums = moments.segment_sums(rows)
    return sums.select(named.alias("seg"), F.col("n").cast("long").alias("n"), *[(F.round(c, 2) + 0.0).alias(c) for c in ("s", "sxy")], "low", "high")


@query("SELECT p_brand, bool_and(p_size * 0 = 0) AS zero, bool_and(p_size = 0) AS size_zero FROM part GROUP BY p_brand")
def all_zero_space(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand")
    return g.agg((F.max(F.abs(F.col("p_size") * 0)) == 0).alias("zero"), (F.max(F.abs("p_size")) == 0).alias("size_zero"))


# ---------------------------------------------------------------- ridge


@query(f"""WITH b AS ({PART}), s AS (SELECT count(*) AS n, corr(x1, y) AS r1, corr(x2, y) AS r2, corr(x1, x2) AS r12 FROM b), l AS (SELECT pow(10.0e0, i - 6) AS lam, i FROM range(16) g(i)),
d AS (SELECT *, n + lam AS a, n * r12 AS o FROM s, l)
SELECT i::INT AS i, round(n * r1 / (n + lam), 6) + 0.0e0 AS w, round((a * n * r1 - o * n * r2) / (a * a - o * o), 6) + 0.0e0 AS w1, round((a * n * r2 - o * n * r1) / (a * a - o * o), 6) + 0.0e0 AS w2 FROM d""")
def ridge_weights(spark, sf_dir):
    """Ridge on one and on two z-scored predictors, over the penalty grid."""
    rows = stack.pack(part_rows(spark, sf_dir), "t", [[F.col("x1")], [F.col("x1"), F.col("x2")]], [F.col("y")])
    path = stack.ridge_path(rows, [1, 2])
    one, two = F.col("space_id") == 0, F.col("space_id") == 1
    pick = lambda space, at: F.max(F.when(space, F.col("weights")[at]))
    return rounded(path.groupBy("i").agg(pick(one, 0).alias("w"), pick(two, 0).alias("w1"), pick(two, 1).alias("w2")), "i")


@query(ORACLE_SQL["ridge_weights"])
def ridge_svd(spark, sf_dir):
    """:func:`ridge_weights` from the singular values of merged QR factors."""
    rows = stack.pack(part_rows(spark, sf_dir), "t", [[F.col("x1")], [F.col("x1"), F.col("x2")]], [F.col("y")])
    path = stack.ridge_path(rows, [1, 2], solver="svd")
    one, two = F.col("space_id") == 0, F.col("space_id") == 1
    pick = lambda space, at: F.max(F.when(space, F.col("weights")[at]))
    return rounded(path.groupBy("i").agg(pick(one, 0).alias("w"), pick(two, 0).alias("w1"), pick(two, 1).alias("w2")), "i")


_COST = f"""WITH b AS ({PART}), f AS (SELECT *, ntile(5) OVER (ORDER BY t) - 1 AS c FROM b),
s AS (SELECT k, corr(x1, y) FILTER (c <> k) AS rt, count(*) FILTER (c <> k) AS nt, corr(x1, y) FILTER (c = k) AS rv FROM f, range(5) q(k) GROUP BY k),
l AS (SELECT i, pow(10.0e0, i - 6) AS lam FROM range(16) g(i)),
cost AS (SELECT i::INT AS i, sum(1 - 2 * (nt * rt / (nt + lam)) * rv + pow(nt * rt / (nt + lam), 2)) AS cost FROM s, l GROUP BY i)"""


def _costs(spark, sf_dir) -> DataFrame:
    return stack.penalty_costs(part_design(spark, sf_dir, 1), [1], 5).select("i", "cost")


@query(_COST + " SELECT i, round(cost, 6) + 0.0e0 AS cost FROM cost")
def ridge_lambda_cost(spark, sf_dir):
    return rounded(_costs(spark, sf_dir), "i")


@query(_COST + " SELECT i, round(cost, 6) + 0.0e0 AS cost FROM cost")
def ridge_svd_cost(spark, sf_dir):
    """:func:`ridge_lambda_cost` by merged QR factors: each split left out of the factor."""
    return rounded(stack.penalty_costs(part_design(spark, sf_dir, 1), [1], 5, solver="svd").select("i", "cost"), "i")


@query(_COST + " SELECT arg_min(i, cost) AS i, round(min(cost), 6) + 0.0e0 AS cost FROM cost")
def ridge_lambda_argmin(spark, sf_dir):
    best = _costs(spark, sf_dir).agg(F.min(F.struct("cost", "i")).alias("best"))
    return rounded(best.select("best.i", "best.cost"), "i")


@query(_COST.replace("ntile(5)", "ntile(10)").replace("range(5) q(k)", "range(10) q(k)") + """, w AS (SELECT i, count(*) * corr(x1, y) / (count(*) + pow(10.0e0, i - 6)) AS w FROM b, (SELECT arg_min(i, cost) AS i FROM cost) GROUP BY i)
SELECT 0::INT AS space_id, 0::INT AS target_id, pow(10.0e0, i - 6) AS penalty, round(w, 6) + 0.0e0 AS w FROM w""")
def ridge_cv_weights(spark, sf_dir):
    """The penalty that a ten-fold search picks, and the weights of the refit on all rows."""
    fitted = stack.cross_val_ridge(part_design(spark, sf_dir, 1), [1], 10)
    return rounded(fitted.select("space_id", "target_id", "penalty", F.col("weights")[0].alias("w")), "space_id", "target_id", "penalty")


@query(f"""WITH b AS ({PART}), s AS (SELECT count(*) AS n, sum(x1 * x1) AS xx, sum(x1 * y) AS xy, sum(x1) AS sx, sum(y) AS sy FROM b)
SELECT solver, round(CASE solver WHEN 'ridge_sk' THEN (xy - sx * sy / n) / (xx - sx * sx / n + 10) ELSE xy / (xx + 10) END, 6) + 0.0e0 AS w FROM s, (VALUES ('plain'), ('svd'), ('ridge_sk')) v(solver)""")
def ridge_solvers(spark, sf_dir):
    """The three solvers on the columns as they are, at one penalty: the last one has an intercept."""
    design = part_design(spark, sf_dir, 1)
    each = [stack.cross_val_ridge(design, [1], 2, [10.0], solver, standardize=False).select(F.lit(solver).alias("solver"), F.col("weights")[0].alias("w")) for solver in SOLVERS]
    return rounded(reduce(DataFrame.unionByName, each), "solver")


@query(f"""WITH f AS (SELECT *, ntile(5) OVER (ORDER BY t) - 1 AS c FROM ({PART})), l AS (SELECT i, pow(10.0e0, i - 6) AS lam FROM range(16) g(i)),
s AS (SELECT k, count(*) AS n, sum(x1 * x1) AS xx, sum(x1 * y) AS xy, sum(x1) AS sx, sum(y) AS sy FROM f, range(5) q(k) WHERE c <> k GROUP BY k),
w AS (SELECT k, i, solver, CASE solver WHEN 'plain' THEN xy / (xx + lam) ELSE (xy - sx * sy / n) / (xx - sx * sx / n + lam) END AS w FROM s, l, (VALUES ('plain'), ('ridge_sk')) v(solver)),
e AS (SELECT k, i, solver, avg(pow(y - w * x1, 2)) / var_pop(y) AS cost FROM w JOIN f ON f.c = w.k GROUP BY ALL)
SELECT solver, i::INT AS i, round(sum(cost), 6) + 0.0e0 AS cost FROM e GROUP BY ALL""")
def ridge_raw_cost(spark, sf_dir):
    """The penalty search on the columns as they are, without and with a centred fit."""
    rows = part_design(spark, sf_dir, 1)
    each = [stack.penalty_costs(rows, [1], 5, solver=s, standardize=False).select(F.lit(s).alias("solver"), "i", "cost") for s in ("plain", "ridge_sk")]
    return rounded(each[0].unionByName(each[1]), "solver", "i")


# ---------------------------------------------------------------- stacked regression


@query(nested_sql("SELECT k::INT AS outer_fold, round(p11, 6) + 0.0e0 AS p11, round(p12, 6) + 0.0e0 AS p12, round(p22, 6) + 0.0e0 AS p22, round(w1, 6) + 0.0e0 AS w1 FROM sw"))
def error_cross_moment(spark, sf_dir):
    stats = stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4)
    p = [F.col("p")[i] for i in (0, 1, 3)]
    return rounded(stats.select("outer_fold", p[0].alias("p11"), p[1].alias("p12"), p[2].alias("p22"), simplex_two(*p).alias("w1")), "outer_fold")


@query(nested_sql(SPACE_FINAL))
def stack_cv_spaces(spark, sf_dir):
    return rounded(stack.space_scores(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4), 2), "target_id", "space_id")


@query(nested_sql(TARGET_FINAL))
def stack_cv(spark, sf_dir):
    return rounded(stack.target_scores(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4), 2), "target_id")


#: A space of an embedding's first number, one of the size of the part that the position names, and a target of both.
_APART = """SELECT t, e1 AS x1, p_size::DOUBLE AS x2, e1 + 0.02e0 * p_size + 0.1e0 * e2 AS y
    FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS t, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2 FROM embeddings) e
    JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS at, p_size, count(*) OVER () AS parts FROM part) p ON e.t % p.parts = p.at"""


def separate_tables(spark: SparkSession, sf_dir: str, buckets: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two spaces and the targets as three tables in buckets of ``t``."""
    e = dense_index(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id").select("t", "e")
    p = dense_index(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", name="at").select("at", F.col("p_size").cast("double").alias("size"))
    sized = e.withColumn("at", F.col("t") % p.count()).join(p, "at")
    first = design.bucketed(e.select("t", F.array(F.col("e")[0]).alias("x")), buckets)
    second = design.bucketed(sized.select("t", F.array("size").alias("x")), buckets)
    y = F.col("e")[0] + 0.02 * F.col("size") + 0.1 * F.col("e")[1]
    return first, second, design.bucketed(sized.select("t", F.array(y).alias("y")), buckets)


@query(nested_sql(SPACE_FINAL, base=_APART))
def stack_separate_tables(spark, sf_dir):
    """Scores of a stack whose spaces and targets are tables of their own, joined by position without a shuffle."""
    first, second, targets = separate_tables(spark, sf_dir)
    rows, dims = design.from_spaces([first, second], targets)
    return rounded(stack.space_scores(stack.fold_stats(rows, dims, 4), 2), "target_id", "space_id")


#: All supports of three spaces, each with its optimum in closed form; the best that is on the simplex wins.
_THREE = """, m AS (SELECT k, max(p) FILTER (i = 1 AND j = 1) AS a, max(p) FILTER (i = 2 AND j = 2) AS b, max(p) FILTER (i = 3 AND j = 3) AS c,
      max(p) FILTER (i = 1 AND j = 2) AS ab, max(p) FILTER (i = 1 AND j = 3) AS ac, max(p) FILTER (i = 2 AND j = 3) AS bc FROM pmat GROUP BY k),
    u AS (SELECT *, (b * c - bc * bc) - (ab * c - ac * bc) + (ab * bc - ac * b) AS u1, (a * c - ac * ac) - (ab * c - ac * bc) - (a * bc - ab * ac) AS u2, (a * b - ab * ab) + (ab * bc - ac * b) - (a * bc - ab * ac) AS u3 FROM m),
    each AS (SELECT k, a, b, c, ab, ac, bc, unnest([
      {'w1': 1e0, 'w2': 0e0, 'w3': 0e0}, {'w1': 0e0, 'w2': 1e0, 'w3': 0e0}, {'w1': 0e0, 'w2': 0e0, 'w3': 1e0},
      {'w1': (b - ab) / (a + b - 2 * ab), 'w2': (a - ab) / (a + b - 2 * ab), 'w3': 0e0}, {'w1': (c - ac) / (a + c - 2 * ac), 'w2': 0e0, 'w3': (a - ac) / (a + c - 2 * ac)},
      {'w1': 0e0, 'w2': (c - bc) / (b + c - 2 * bc), 'w3': (b - bc) / (b + c - 2 * bc)}, {'w1': u1 / (u1 + u2 + u3), 'w2': u2 / (u1 + u2 + u3), 'w3': u3 / (u1 + u2 + u3)}], recursive := true) FROM u),
    valued AS (SELECT *, w1 * w1 * a + w2 * w2 * b + w3 * w3 * c + 2 * (w1 * w2 * ab + w1 * w3 * ac + w2 * w3 * bc) AS value FROM each WHERE least(w1, w2, w3) >= 0),
    chosen AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY k ORDER BY value) = 1)"""


@query(nested_sql(_THREE + " SELECT k::INT AS outer_fold, round(w1, 6) + 0.0e0 AS w1, round(w2, 6) + 0.0e0 AS w2, round(w3, 6) + 0.0e0 AS w3 FROM chosen", spaces=3))
def stack_weights_three(spark, sf_dir):
    """Stack weights of three spaces per outer fold."""
    stats = stack.fold_stats(part_design(spark, sf_dir, 3), [1, 1, 1], 4)
    w = [F.col("w")[i].alias(f"w{i + 1}") for i in range(3)]
    return rounded(stack.weighted(stats, 3).select("outer_fold", *w), "outer_fold")


@query(nested_sql(_THREE + """, mixed AS (SELECT t, any_value(yg) AS yg, sum(pred * CASE s WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END) AS pred FROM test JOIN whole_z USING (t) JOIN chosen USING (k) GROUP BY t)
    SELECT 0::INT AS target_id, round((SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM mixed), 6) + 0.0e0 AS stacked_r2, round((SELECT avg(1 - value) FROM chosen), 6) + 0.0e0 AS stacked_train_r2""", spaces=3))
def stack_cv_three(spark, sf_dir):
    """Test and train scores of a stack of three spaces."""
    return rounded(stack.target_scores(stack.fold_stats(part_design(spark, sf_dir, 3), [1, 1, 1], 4), 3), "target_id")


def _train_test(spark, sf_dir) -> DataFrame:
    design = part_design(spark, sf_dir)
    return stack.fold_stats(design, [1, 1], train_end=int(0.7 * design.count()))


@query(nested_sql(TARGET_FINAL, train_share=0.7))
def stack_train_test(spark, sf_dir):
    return rounded(stack.target_scores(_train_test(spark, sf_dir), 2), "target_id")


@query(nested_sql(SPACE_FINAL, train_share=0.7))
def stack_train_test_spaces(spark, sf_dir):
    return rounded(stack.space_scores(_train_test(spark, sf_dir), 2), "target_id", "space_id")


@query(nested_sql(SPACE_FINAL, method="simple_ridge"))
def simple_ridge(spark, sf_dir):
    return rounded(stack.space_scores(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4, method="simple_ridge"), 2), "target_id", "space_id")


def concat_sql(folds: int, final: str, models: int = 1) -> str:
    """Ridge on two z-scored predictors side by side, the 2 x 2 system in closed form; models 1 and 2 have one of them."""
    return f"""WITH b AS ({PART}), nn AS (SELECT count(*) AS n FROM b), f AS (SELECT *, least(t // (n // {folds}), {folds - 1}) AS fold, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS yg FROM b, nn),
    tr AS (SELECT k, t, x1, x2, y, ntile(5) OVER (PARTITION BY k ORDER BY t) - 1 AS c FROM f, range({folds}) o(k) WHERE fold <> k),
    s AS (SELECT k, q, count(*) FILTER (c <> q) AS n, corr(x1, y) FILTER (c <> q) AS r1, corr(x2, y) FILTER (c <> q) AS r2, corr(x1, x2) FILTER (c <> q) AS r12,
      corr(x1, y) FILTER (c = q) AS v1, corr(x2, y) FILTER (c = q) AS v2, corr(x1, x2) FILTER (c = q) AS v12 FROM tr, range(-1, 5) g(q) GROUP BY ALL),
    l AS (SELECT i, pow(10.0e0, i - 6) AS lam FROM range(16) g(i)),
    w AS (SELECT *, CASE model WHEN 0 THEN ((n + lam) * n * r1 - n * r12 * n * r2) / ((n + lam) * (n + lam) - n * r12 * n * r12) WHEN 1 THEN n * r1 / (n + lam) ELSE 0 END AS w1,
      CASE model WHEN 0 THEN ((n + lam) * n * r2 - n * r12 * n * r1) / ((n + lam) * (n + lam) - n * r12 * n * r12) WHEN 2 THEN n * r2 / (n + lam) ELSE 0 END AS w2 FROM s, l, range({models}) g(model)),
    cost AS (SELECT k, model, i, sum(1 - 2 * (w1 * v1 + w2 * v2) + w1 * w1 + w2 * w2 + 2 * w1 * w2 * v12) AS cost FROM w WHERE q >= 0 GROUP BY ALL),
    best AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY k, model ORDER BY cost, i) = 1),
    p AS (SELECT best.model, yg, w1 * (x1 - avg(x1) OVER v) / stddev_pop(x1) OVER v + w2 * (x2 - avg(x2) OVER v) / stddev_pop(x2) OVER v AS pred
      FROM f JOIN best ON best.k = f.fold JOIN w ON w.k = best.k AND w.i = best.i AND w.q = -1 AND w.model = best.model WINDOW v AS (PARTITION BY best.model, fold))
    {final}"""


@query(concat_sql(4, "SELECT 0::INT AS target_id, round(1 - avg(pow(yg - pred, 2)) / var_pop(yg), 6) + 0.0e0 AS concat_r2, round(corr(pred, yg), 6) + 0.0e0 AS concat_corr FROM p"))
def concat_cv(spark, sf_dir):
    design = part_design(spark, sf_dir)
    by_corr = concat.concat_cv(design, [1, 1], 4, score=Correlation()).withColumnRenamed("concat_r2", "concat_corr")
    return rounded(concat.concat_cv(design, [1, 1], 4).join(by_corr, "target_id"), "target_id")


_CONCAT_CHAIN = """, r AS (SELECT model, 1 - avg(pow(yg - pred, 2)) / var_pop(yg) AS r2 FROM p GROUP BY model),
    c AS (SELECT d AS direction, CASE WHEN model = 0 THEN 0 ELSE 1 END AS step, r2 FROM r, (VALUES ('forward', 1), ('backward', 2)) v(d, lost) WHERE model <> lost)
    SELECT direction, step::INT AS step, round(r2, 6) + 0.0e0 AS r2, round(r2 - coalesce(lead(r2) OVER (PARTITION BY direction ORDER BY step), 0), 6) + 0.0e0 AS vp FROM c"""


@query(concat_sql(4, _CONCAT_CHAIN, models=3))
def concat_chain(spark, sf_dir):
    """Both chains of the concatenated model, and what each step loses: the first is the concatenated leave-one-out."""
    chains = concat.concat_chain(part_design(spark, sf_dir), [1, 1], 4)
    return rounded(varpart.unique_variance(chains, "target_id", "direction").select("direction", "step", "r2", "vp"), "direction", "step")


@query(nested_sql("SELECT o.k::INT AS outer_fold, (o.s - 1)::INT AS space_id, o.t, round(pred, 6) + 0.0e0 AS pred, round(yz - pred, 6) + 0.0e0 AS error FROM oof o"))
def oof_predictions(spark, sf_dir):
    """Every train row's prediction by the inner fold that leaves it out, and its error."""
    rows = predict.long_predictions(stack.fit_folds(part_design(spark, sf_dir), [1, 1], 4), train=True)
    return rounded(rows.select("outer_fold", "space_id", "t", "pred", (F.col("real") - F.col("pred")).alias("error")), "outer_fold", "space_id", "t")


@query(nested_sql("SELECT (s - 1)::INT AS space_id, t, round(pred, 6) + 0.0e0 AS pred, round(yg, 6) + 0.0e0 AS real FROM pooled UNION ALL SELECT NULL, t, round(pred, 6) + 0.0e0, round(yg, 6) + 0.0e0 FROM stacked"))
def test_predictions(spark, sf_dir):
    """Every row's prediction while its fold is held out, per space and (null) stacked."""
    fitted = stack.fit_folds(part_design(spark, sf_dir), [1, 1], 4)
    rows = predict.long_predictions(fitted).select("space_id", "t", "pred", "real")
    both = rows.unionByName(predict.stacked_predictions(fitted).select(F.lit(None).cast("int").alias("space_id"), "t", "pred", "real"))
    return rounded(both, "space_id", "t")


@query(nested_sql("""SELECT (s - 1)::INT AS space_id, round(corr(pred, yg), 6) + 0.0e0 AS score, round(corr(sw * pred, yg), 6) + 0.0e0 AS score_weighted,
      (SELECT round(avg(c), 6) + 0.0e0 FROM (SELECT corr(o.pred, o.yz) AS c FROM oof o WHERE o.s = pooled.s GROUP BY o.k)) AS score_train FROM pooled GROUP BY s
    UNION ALL SELECT NULL, round(corr(pred, yg), 6) + 0.0e0, round(corr(pred, yg), 6) + 0.0e0,
      (SELECT round(avg(c), 6) + 0.0e0 FROM (SELECT k, corr(pred, yz) AS c FROM (SELECT k, t, any_value(yz) AS yz, sum(pred * CASE WHEN s = 1 THEN w1 ELSE 1 - w1 END) AS pred FROM oof JOIN sw USING (k) GROUP BY k, t) GROUP BY k)) FROM stacked"""))
def stack_cv_corr(spark, sf_dir):
    """The stack's and its spaces' scores, of test and train rows, by another function: the correlation."""
    fitted = stack.fit_folds(part_design(spark, sf_dir), [1, 1], 4)
    return rounded(predict.scored(fitted, Correlation()).select("space_id", "score", "score_weighted", "score_train"), "space_id")


@query(nested_sql("SELECT k::INT AS outer_fold, (s - 1)::INT AS space_id, round(var_pop(pred), 6) + 0.0e0 AS variance FROM oof GROUP BY k, s"))
def train_variance(spark, sf_dir):
    found = stack.train_variance(stack.fit_folds(part_design(spark, sf_dir), [1, 1], 4))
    return rounded(found.select("outer_fold", "space_id", "variance"), "outer_fold", "space_id")


@query(nested_sql(SPACE_FINAL.replace("SELECT 0::INT AS target_id, (s - 1)", ", e AS (SELECT 0::INT AS target_id, (s - 1)") + ") SELECT target_id, max(r2) FILTER (space_id < 1) AS max, max(r2) AS max_all FROM e GROUP BY target_id"))
def max_over_spaces(spark, sf_dir):
    scores = stack.space_scores(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4), 2)
    return rounded(varpart.max_over_spaces(scores, first=1), "target_id")


@query(f"""WITH b AS ({PART}), nn AS (SELECT count(*) AS n FROM b), f AS (SELECT *, least(t // (n // 10), 9) AS fold FROM b, nn),
tr AS (SELECT k, t, x1, y, ntile(10) OVER (PARTITION BY k ORDER BY t) - 1 AS c FROM f, range(10) o(k) WHERE fold <> k),
s AS (SELECT k, cc, corr(x1, y) FILTER (c <> cc) AS rt, count(*) FILTER (c <> cc) AS nt, corr(x1, y) FILTER (c = cc) AS rv FROM tr, range(10) q(cc) GROUP BY ALL),
l AS (SELECT i, pow(10.0e0, i - 6) AS lam FROM range(16) g(i)),
cost AS (SELECT k, i, lam, sum(1 - 2 * (nt * rt / (nt + lam)) * rv + pow(nt * rt / (nt + lam), 2)) AS cost FROM s, l GROUP BY ALL),
best AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, i) = 1),
w AS (SELECT k, count(*) * corr(x1, y) / (count(*) + any_value(lam)) AS w FROM tr JOIN best USING (k) GROUP BY k),
p AS (SELECT y, w * (x1 - avg(x1) OVER v) / stddev_pop(x1) OVER v AS pred FROM f JOIN w ON w.k = f.fold WINDOW v AS (PARTITION BY fold))
SELECT 0::INT AS target_id, round(corr(pred, y), 6) + 0.0e0 AS corr, round(1 - avg(pow(y - pred, 2)) / var_pop(y), 6) + 0.0e0 AS r2 FROM p""")
def fit_predict(spark, sf_dir):
    return rounded(stack.fit_predict(part_design(spark, sf_dir, 1), 1, 10), "target_id")


@query("SELECT vec_id, list_concat(embedding[1:16], embedding[33:48])::DOUBLE[] AS x FROM embeddings")
def hstack_spaces(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.slice("embedding", 1, 16), F.slice("embedding", 33, 16)).cast("array<double>").alias("x"))


@query()
def stack_cv_embeddings(spark, sf_dir):
    return rounded(stack.space_scores(stack.fold_stats(embedding_design(spark, sf_dir), DIMS, 4), 4), "target_id", "space_id")


@query()
def concat_cv_embeddings(spark, sf_dir):
    return rounded(concat.concat_cv(embedding_design(spark, sf_dir), DIMS, 4), "target_id")


# ---------------------------------------------------------------- variance partitioning


def _chains(spark, sf_dir, direction: str) -> DataFrame:
    """A chain of scores per brand, from sums of squares that ``part`` gives: seven steps."""
    p = table(spark, sf_dir, "part")
    sums = p.groupBy("p_brand").agg(F.avg("p_size").alias("a"), F.avg(F.col("p_partkey") * 7919 % 1000).alias("b"))
    swing = F.pmod(F.floor(F.col("a") * 1000 + F.col("b") * 10), F.lit(97)).cast("double") / 97
    at = F.explode(F.array(*[F.lit(s) for s in range(7)])).alias("step")
    sign = -0.13 if direction == "forward" else -0.09
    r2 = F.round(F.col("swing") + sign * F.col("step") * F.col("swing") + 0.01 * (F.col("step") % 3), 9) - 0.2
    return sums.select("p_brand", swing.alias("swing"), at).select("p_brand", "step", r2.alias("r2"))


def _chain_sql(direction: str) -> str:
    sign = "-0.13e0" if direction == "forward" else "-0.09e0"
    return f"""WITH s AS (SELECT p_brand, avg(p_size) AS a, avg(p_partkey * 7919 % 1000) AS b FROM part GROUP BY p_brand),
    g AS (SELECT p_brand, (floor(a * 1000 + b * 10)::BIGINT % 97)::DOUBLE / 97 AS swing FROM s),
    ch AS (SELECT p_brand, step::INT AS step, round(swing + {sign} * step * swing + 0.01e0 * (step % 3), 9) - 0.2e0 AS r2 FROM g, range(7) r(step))"""


def _vp_sql(direction: str) -> str:
    return _chain_sql(direction) + """, v AS (SELECT *, r2 - coalesce(lead(r2) OVER (PARTITION BY p_brand ORDER BY step), 0e0) AS vp FROM ch)
    SELECT p_brand, step, round(r2, 6) + 0.0e0 AS r2, round(vp, 6) + 0.0e0 AS vp, round(CASE WHEN vp >= 0 THEN sqrt(vp) ELSE 'NaN'::DOUBLE END, 6) + 0.0e0 AS vp_sqrt FROM v"""


@query(_vp_sql("forward"))
def vp_forward(spark, sf_dir):
    return rounded(varpart.unique_variance(_chains(spark, sf_dir, "forward"), "p_brand"), "p_brand", "step")


@query(_vp_sql("backward"))
def vp_backward(spark, sf_dir):
    return rounded(varpart.unique_variance(_chains(spark, sf_dir, "backward"), "p_brand"), "p_brand", "step")


def _layer_sql(direction: str) -> str:
    hit = "min(step) FILTER (step > 0 AND r2 < 0.95e0 * r0)"
    layer = f"coalesce({hit}, 7)" if direction == "forward" else f"8 - coalesce({hit}, 7)"
    return _chain_sql(direction) + f""", f AS (SELECT *, first(r2) OVER (PARTITION BY p_brand ORDER BY step) AS r0 FROM ch)
    SELECT p_brand, CASE WHEN any_value(r0) <= 0 THEN 'NaN'::DOUBLE ELSE {layer} END::DOUBLE AS layer FROM f GROUP BY p_brand"""


@query(_layer_sql("forward"))
def attribution_forward(spark, sf_dir):
    return varpart.attribution(_chains(spark, sf_dir, "forward"), "p_brand")


@query(_layer_sql("backward"))
def attribution_backward(spark, sf_dir):
    return varpart.attribution(_chains(spark, sf_dir, "backward"), "p_brand", backward=True)


@query()
def chain_embeddings(spark, sf_dir):
    """Both chains of the planted spaces, from one set of fits."""
    stats = stack.fold_stats(embedding_design(spark, sf_dir), DIMS, 4)
    both = varpart.chain(stats, 4, "forward", "backward")
    return rounded(varpart.unique_variance(both, "target_id", "direction"), "target_id", "direction", "step")


_TWO_SCORES = """, r AS (SELECT (SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM stacked) AS r_all, (SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM pooled WHERE s = 1) AS r_one,
    (SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM pooled WHERE s = 2) AS r_two)"""


@query(nested_sql(_TWO_SCORES + """, c AS (SELECT d AS direction, s::INT AS step, CASE WHEN s = 0 THEN r_all WHEN d = 'forward' THEN r_two ELSE r_one END AS r2 FROM r, range(2) g(s), (VALUES ('forward'), ('backward')) v(d))
    SELECT direction, step, round(r2, 6) + 0.0e0 AS r2, round(r2 - coalesce(lead(r2) OVER (PARTITION BY direction ORDER BY step), 0), 6) + 0.0e0 AS vp FROM c"""))
def chain_part(spark, sf_dir):
    """Both chains of two spaces, with the variance that each step loses."""
    chains = varpart.chain(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4), 2, "forward", "backward")
    return rounded(varpart.unique_variance(chains, "target_id", "direction").select("direction", "step", "r2", "vp"), "direction", "step")


@query(_chain_sql("forward") + " SELECT 'forward' AS direction, step, p_brand AS shard, round(r2, 6) + 0.0e0 AS r2 FROM ch WHERE step >= 3")
def chain_shards(spark, sf_dir):
    """Chains written by direction, step and shard, read back with a filter that prunes the files. The terminal
    step comes from the single-space scores, which lie apart."""
    folder = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    rows = _chains(spark, sf_dir, "forward").select(F.lit("forward").alias("direction"), "step", F.col("p_brand").alias("shard"), F.xxhash64("p_brand").alias("target_id"), "r2")
    write_results(rows.where("step < 6"), folder, "direction", "step", "shard")
    singles = rows.where("step = 6").select("target_id", F.lit(6).alias("space_id"), "r2")
    shards = read_chain(spark, folder)
    whole = varpart.with_single_space(shards.where("direction = 'forward' AND step >= 3"), singles, 7)
    named = whole.join(shards.select("target_id", "shard").distinct(), "target_id")
    return rounded(named.select("direction", "step", "shard", "r2"), "direction", "step", "shard")


@query(_chain_sql("backward") + """ SELECT 'backward' AS direction, step, (substr(p_brand, 7)::INT % 5)::INT AS shard, row_number() OVER (PARTITION BY step, substr(p_brand, 7)::INT % 5 ORDER BY substr(p_brand, 7)::INT) - 1 AS row,
    round(r2, 6) + 0.0e0 AS r2 FROM ch WHERE step IN (1, 4)""")
def chain_npy(spark, sf_dir):
    """Chains written as NumPy's files, by direction, step and shard (brands by their number), and two steps of them read back."""
    folder = f"{shared_folder(spark)}/chain-npy-{uuid.uuid4().hex}"
    brand = F.substring("p_brand", 7, 9).cast("int")
    at = F.row_number().over(Window.partitionBy("direction", "step", "shard").orderBy(brand)) - 1  # some brands a shard
    rows = reduce(DataFrame.unionByName, [_chains(spark, sf_dir, d).select(F.lit(d).alias("direction"), "p_brand", "step", (brand % 5).alias("shard"), "r2") for d in ("forward", "backward")])
    rows = rows.withColumn("row", at)
    npy.write_chain(rows, folder)
    return rounded(npy.read_chain(spark, folder).where("direction = 'backward' AND step IN (1, 4)"), "direction", "step", "shard", "row")


@query(nested_sql("SELECT 0::INT AS target_id, round((SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM stacked) - (SELECT 1 - avg(pow(yg - pred, 2)) / var_pop(yg) FROM pooled WHERE s = 2), 6) + 0.0e0 AS varpar"))
def leave_first_out(spark, sf_dir):
    chain = varpart.chain(stack.fold_stats(part_design(spark, sf_dir), [1, 1], 4), 2)
    lost = varpart.unique_variance(chain, "target_id").where("step = 0")
    return rounded(lost.select("target_id", F.col("vp").alias("varpar")), "target_id")


# ---------------------------------------------------------------- reports


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_discount - l_tax), 6) + 0.0e0 AS mean_diff, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) + 0.0e0 AS t FROM lineitem GROUP BY l_returnflag")
def paired_t(spark, sf_dir):
    return rounded(report.paired_t(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag"), "l_returnflag", "n")


#: Student's t by Simpson's rule over the density.
def verdict_sql(keys: str, difference: str) -> str:
    return f"""WITH s AS (SELECT {keys}, count(*) AS n, avg({difference}) AS m, avg({difference}) / (stddev_samp({difference}) / sqrt(count(*))) AS t FROM lineitem GROUP BY ALL),
d AS (SELECT *, n - 1 AS df, least(abs(t), 40e0) / 2000 AS h FROM s WHERE n > 1),
a AS (SELECT {keys}, n, m, t, 1 - 2 * exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(df * pi()) * sum(h / 3 * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + h * i * h * i / df, -(df + 1) / 2e0)) AS p
  FROM d, range(2001) g(i) GROUP BY {keys}, n, m, t, df),
v AS (SELECT *, CASE WHEN p >= 0.0025e0 THEN NULL WHEN t > 0 THEN 'second' ELSE 'first' END AS verdict FROM a)"""


_VERDICTS = verdict_sql("l_returnflag, l_linestatus, l_linenumber", "l_discount - l_tax")


def _verdicts(spark, sf_dir) -> DataFrame:
    tests = report.paired_t(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")
    return report.with_verdict(tests.where("n > 1"))


@query(_VERDICTS + " SELECT l_returnflag, l_linestatus, l_linenumber, n, round(m, 6) + 0.0e0 AS mean_diff, round(t, 6) + 0.0e0 AS t, round(abs(p), 6) + 0.0e0 AS p, verdict FROM v")
def verdict(spark, sf_dir):
    return rounded(_verdicts(spark, sf_dir), "l_returnflag", "l_linestatus", "l_linenumber", "n", "verdict")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, round(q1, 6) + 0.0e0 AS q1, round(median, 6) + 0.0e0 AS median, round(q3, 6) + 0.0e0 AS q3, round(min(value), 6) + 0.0e0 AS low, round(max(value), 6) + 0.0e0 AS high
FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY ALL""")
def five_number(spark, sf_dir):
    return rounded(report.five_number(table(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type"), "event_type")


# ---------------------------------------------------------------- SQL text


def _in_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement in which ``{name}`` stands for the table."""
    sql.register(spark)
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


@query("""WITH n AS (SELECT count(*) AS n FROM part) SELECT 'last' AS rule, f AS fold, f * (n // 7) AS start, CASE WHEN f = 6 THEN n ELSE (f + 1) * (n // 7) END AS stop FROM n, range(7) g(f)
    UNION ALL SELECT 'first', f, f * (n // 7) + least(f, n % 7), (f + 1) * (n // 7) + least(f + 1, n % 7) FROM n, range(7) g(f)""")
def sql_fold_bounds(spark, sf_dir):
    return _in_sql(spark, sf_dir, """WITH n AS (SELECT count(*) AS n FROM {part})
        SELECT 'last' AS rule, b.* FROM n, LATERAL fold_bounds(n.n, 7L) b UNION ALL SELECT 'first', b.* FROM n, LATERAL fold_bounds_ntile(n.n, 7L) b""")


_TWO_ERRORS = "SELECT l_shipmode, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_discount - 0.02e0 * l_linenumber AS a, l_tax - 0.001e0 * l_quantity AS b FROM {}) GROUP BY l_shipmode"


@query(f"""WITH p AS ({_TWO_ERRORS.format("lineitem")}), w AS (SELECT l_shipmode, aa, greatest(0e0, least(1e0, (bb - ab) / (aa + bb - 2 * ab))) AS w FROM p) SELECT l_shipmode, round(w, 6) + 0.0e0 AS w1, round(1 - w, 6) + 0.0e0 AS w2 FROM w""")
def sql_simplex_weights(spark, sf_dir):
    text = f"WITH p AS ({_TWO_ERRORS.format('{lineitem}')}), w AS (SELECT l_shipmode, simplex_weights(array(aa, ab, ab, bb)) AS w FROM p) SELECT l_shipmode, round(w[0], 6) + 0.0D AS w1, round(w[1], 6) + 0.0D AS w2 FROM w"
    return _in_sql(spark, sf_dir, text.replace("e0", "D"))


@query("SELECT l_returnflag, round(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice), 6) + 0.0e0 AS r2 FROM lineitem GROUP BY l_returnflag")
def sql_r2(spark, sf_dir):
    return _in_sql(spark, sf_dir, "SELECT l_returnflag, round(r2, 6) + 0.0D AS r2 FROM (SELECT l_returnflag, r2(avg(pow(l_extendedprice - 1500 * l_quantity, 2)), var_pop(l_extendedprice)) AS r2 FROM {lineitem} GROUP BY l_returnflag)")


@query(_VERDICTS + " SELECT l_returnflag, l_linestatus, l_linenumber, round(abs(p), 6) + 0.0e0 AS p FROM v")
def sql_t_pvalue(spark, sf_dir):
    return _in_sql(spark, sf_dir, """WITH s AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS t FROM {lineitem} GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, l_linenumber, round(t_pvalue(t, CAST(n - 1 AS DOUBLE)), 6) + 0.0D AS p FROM s WHERE n > 1""")


# ---------------------------------------------------------------- more reports


@query("""SELECT l_orderkey, l_partkey, method, r2 FROM (SELECT l_orderkey, l_partkey, l_discount AS stacked, l_tax AS concat FROM lineitem) UNPIVOT (r2 FOR method IN (stacked, concat))""")
def tidy_methods(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_discount").alias("stacked"), F.col("l_tax").alias("concat"))
    return report.tidy(wide, ["l_orderkey", "l_partkey"], ["stacked", "concat"])


@query("SELECT p_size, (dense_rank() OVER (ORDER BY p_size) - 1)::BIGINT AS setting_id FROM (SELECT DISTINCT p_size FROM part)")
def setting_rank(spark, sf_dir):
    return report.setting_rank(table(spark, sf_dir, "part"), "p_size")


@query(_VERDICTS + """ SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, count(*) AS settings, count(*) FILTER (verdict = 'second') AS second_better, count(*) FILTER (verdict = 'first') AS first_better FROM v
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))""")
def reliability_by_param(spark, sf_dir):
    """Verdicts per setting, counted over each parameter's values."""
    rows = _verdicts(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    return report.reliability(rows, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, round(abs(l_discount - l_quantity / 500), 6) + 0.0e0 AS l_discount, round(abs(l_tax - l_quantity / 500), 6) + 0.0e0 AS l_tax FROM lineitem")
def absolute_error(spark, sf_dir):
    """Two estimates' distances from a truth, here planted in the quantity."""
    rows = table(spark, sf_dir, "lineitem").withColumn("truth", F.col("l_quantity") / 500)
    found = report.absolute_errors(rows, ["l_discount", "l_tax"], "truth")
    return rounded(found.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_orderkey", "l_linenumber")


def _report(spark, sf_dir) -> dict[str, DataFrame]:
    """The one-factor report with the line number as the setting, two estimates, and a truth planted in the quantity."""
    results = table(spark, sf_dir, "lineitem").withColumn("truth", F.col("l_quantity") / 500)
    return report.simulation_report(results, "l_linenumber", "l_discount", "l_tax", "truth", ("l_quantity", "l_discount"))


@query(verdict_sql("l_linenumber", "abs(l_discount - l_quantity / 500) - abs(l_tax - l_quantity / 500)") + " SELECT l_linenumber, n, round(m, 6) + 0.0e0 AS mean_diff, round(t, 6) + 0.0e0 AS t, round(abs(p), 6) + 0.0e0 AS p, verdict FROM v")
def report_tests(spark, sf_dir):
    """Paired tests of two estimates' errors per setting."""
    return rounded(_report(spark, sf_dir)["tests"], "l_linenumber", "n", "verdict")


@query("""WITH e AS (SELECT l_linenumber, method, error FROM (SELECT l_linenumber, abs(l_discount - l_quantity / 500) AS l_discount, abs(l_tax - l_quantity / 500) AS l_tax FROM lineitem) UNPIVOT (error FOR method IN (l_discount, l_tax))),
q AS (SELECT l_linenumber, method, quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS q3 FROM e GROUP BY ALL)
SELECT l_linenumber, method, round(q1, 6) + 0.0e0 AS q1, round(median, 6) + 0.0e0 AS median, round(q3, 6) + 0.0e0 AS q3, round(min(error), 6) + 0.0e0 AS low, round(max(error), 6) + 0.0e0 AS high
FROM e JOIN q USING (l_linenumber, method) WHERE error BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY ALL""")
def report_boxes(spark, sf_dir):
    """Five numbers of each estimate's errors per setting."""
    return rounded(_report(spark, sf_dir)["boxes"], "l_linenumber", "method")


@query("SELECT l_linenumber, method, r2 FROM (SELECT l_linenumber, l_quantity, l_discount FROM lineitem) UNPIVOT (r2 FOR method IN (l_quantity, l_discount))")
def report_scores(spark, sf_dir):
    """The methods' values of all runs as a tidy frame."""
    return _report(spark, sf_dir)["scores"]


@query("""SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, round(avg(l_discount - l_tax), 6) + 0.0e0 AS diff FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linestatus, l_linenumber))""")
def error_by_param_pair(spark, sf_dir):
    diff = (F.round(F.avg(F.col("l_discount") - F.col("l_tax")), DIGITS) + 0.0).alias("diff")
    rows = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    return report.by_parameter(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], [diff], size=2)


@query("SELECT event_id, event_type AS shard, value FROM events")
def union_shards(spark, sf_dir):
    """Shards by event type, put together again."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("shard"), "value")
    common = F.coalesce(F.col("shard").isin("click", "view", "purchase"), F.lit(False))
    return e.where(common).unionByName(e.where(~common))


@query(f"""WITH b AS ({PART}), s AS (SELECT DISTINCT x1 AS v FROM b) SELECT a.v AS i, c.v AS j, round(exp(-pow(a.v - c.v, 2) / ((SELECT count(*) FROM s) * 0.5e0)), 9) + 0.0e0 AS c FROM s a, s c""")
def toeplitz_cov(spark, sf_dir):
    """The covariance over the table's distinct part sizes as positions (fifty at most, in any table)."""
    s = part_rows(spark, sf_dir).select(F.col("x1").alias("v")).distinct()
    n = s.agg(F.count("*").alias("n"))
    pairs = s.select(F.col("v").alias("i")).crossJoin(s.select(F.col("v").alias("j"))).crossJoin(n)
    c = F.exp(-F.pow(F.col("i") - F.col("j"), 2) / (F.col("n") * 0.5))
    return pairs.select("i", "j", (F.round(c, 9) + 0.0).alias("c"))


@query("""WITH n AS (SELECT p_size AS n, row_number() OVER (ORDER BY p_size) - 1 AS i FROM (SELECT DISTINCT p_size FROM part)), s AS (SELECT d AS sigma, row_number() OVER (ORDER BY d) - 1 AS j FROM (SELECT DISTINCT l_discount::DOUBLE AS d FROM lineitem)),
t AS (SELECT (i * (SELECT count(*) FROM s) + j) * 5 + run AS global_index, n, sigma, run FROM n, s, range(5) r(run))
SELECT global_index::BIGINT AS global_index, n::INT AS n, 10::INT AS d1, 20::INT AS d2, 30::INT AS d3, 40::INT AS d4, 0.4e0 AS alpha1, 0.3e0 AS alpha2, 0.2e0 AS alpha3, 0.1e0 AS alpha4, sigma, 0.0e0 AS correl, run::INT AS run
FROM t WHERE global_index >= 100 AND global_index <= (SELECT max(global_index) FROM t) - 100""")
def sweep_tasks(spark, sf_dir):
    """The factorial over the sizes found in ``part`` and the discounts found in ``lineitem``, run fastest, less
    a hundred tasks at either end, with the lists of each setting as columns."""
    sizes = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().collect())  # fifty at most
    noises = sorted(r[0] for r in table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double")).distinct().collect())  # eleven
    tasks = sweep.build_tasks(spark, sizes, ((10, 20, 30, 40),), ((0.4, 0.3, 0.2, 0.1),), noises, (0.0,), 5)
    return sweep.unnest(sweep.shard(tasks, 100, len(sizes) * len(noises) * 5 - 101))


@query()
def sweep_run(spark, sf_dir):
    """A simulation experiment per supplier, which gives the seed, the noise and the correlation."""
    s = table(spark, sf_dir, "supplier")
    tasks = s.select(
        F.col("s_suppkey").alias("global_index"), F.lit(40).alias("n"), F.array(F.lit(3), F.lit(3)).alias("ds"), F.array(F.lit(0.7), F.lit(0.3)).alias("alpha"),
        (F.col("s_nationkey") % 4 * 0.5).alias("noise"), (F.col("s_suppkey") % 3 * 0.1).alias("correl"),
    )
    return sweep.run_tasks(tasks).drop("alpha_0")
