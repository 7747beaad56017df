import numpy as np
import pytest

from varistack.jobs import queries
from varistack.operators import design, stack

from .test_stack import data, frame

SF = "/root/testdata/sf0.001"


def spaces(spark, xs, y, buckets=4):
    tables = [spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "t long, x array<double>") for x in xs]
    targets = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(y)], "t long, y array<double>")
    return [design.bucketed(t, buckets) for t in tables], design.bucketed(targets, buckets)


def test_buckets_join_without_exchange(spark):
    xs, y = data(n=60)
    tables, targets = spaces(spark, xs, y)
    rows, dims = design.from_spaces(tables, targets)
    assert dims == [3, 4, 2]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    got = {r.t: (r.x, r.y) for r in rows.collect()}
    assert all(np.allclose(got[i][0], np.concatenate([x[i] for x in xs])) and np.allclose(got[i][1], y[i]) for i in range(60))
    one = stack.space_scores(stack.fold_stats(rows, dims, 4), 3).collect()
    two = stack.space_scores(stack.fold_stats(frame(spark, xs, y), dims, 4), 3).collect()
    key = lambda r: (r.target_id, r.space_id)
    assert np.allclose(sorted(map(tuple, one), key=lambda r: r[:2]), sorted(map(tuple, two), key=lambda r: r[:2]), atol=1e-9) and sorted(map(key, one)) == sorted(map(key, two))


def test_query_plan_has_no_exchange_on_the_joined_side(spark):
    first, second, targets = queries.separate_tables(spark, SF)
    rows, _ = design.from_spaces([first, second], targets)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_tables_that_do_not_fit(spark):
    good = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, None)], "t long, x array<double>")
    y = spark.createDataFrame([(i, [1.0 * i]) for i in range(3)], "t long, y array<double>")
    rows = [[(0, [1.0]), (1, [2.0])], [(0, [1.0]), (1, [2.0]), (1, [3.0])], [(0, [1.0]), (2, [2.0]), (4, [3.0])], [(0, [1.0]), (1, [2.0, 3.0]), (2, [3.0])], [(None, [1.0]), (1, [2.0]), (2, [3.0])], []]
    for bad in [good, *(spark.createDataFrame(r, "t long, x array<double>") for r in rows)]:
        with pytest.raises(ValueError):
            design.from_spaces([bad], y)
    holes = spark.createDataFrame([(0, [1.0]), (1, [None]), (2, [3.0])], "t long, x array<double>")
    joined, dims = design.from_spaces([holes], y)
    assert dims == [1] and np.isnan({r.t: r.x[0] for r in joined.collect()}[1])


def test_tables_are_dropped(spark):
    table = design.bucketed(spark.range(10).withColumnRenamed("id", "t"), 2, name="space_to_drop")
    assert table.count() == 10
    design.drop(spark, "space_to_drop")
    assert not spark.catalog.tableExists("space_to_drop")
