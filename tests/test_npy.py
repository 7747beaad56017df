import numpy as np
import pytest
from pyspark.sql import functions as F

from varistack.sources import npy


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("chains")
    rng = np.random.default_rng(0)
    for shard in range(1, 23):
        for step in range(6):
            np.save(path / npy.file_name("forward", step, shard), rng.standard_normal(7 + shard))
            np.save(path / npy.file_name("backward", step, shard), rng.standard_normal((1, 7 + shard)))
    np.save(path / "r2s_1.npy", np.zeros(3))
    (path / "notes.txt").write_text("x")
    return str(path)


def test_shards_and_pruning(spark, folder, monkeypatch):
    rows = npy.read_chain(spark, folder)
    assert rows.count() == 2 * 6 * sum(7 + s for s in range(1, 23))
    one = rows.where("direction = 'backward' AND step >= 4 AND shard IN (3, 22)")
    assert one.rdd.getNumPartitions() == 4
    got = {(r.step, r.shard, r.row): r.r2 for r in one.collect()}
    for step in (4, 5):
        for shard in (3, 22):
            want = np.load(f"{folder}/{step}_r_stacked_r2s_{shard}.npy").ravel()
            assert [got[step, shard, i] for i in range(len(want))] == want.tolist()
    rest = rows.where("step < 1 AND r2 > 0").collect()
    assert rest and all(r.step == 0 and r.r2 > 0 for r in rest)
    assert rows.where("shard = 99").count() == 0


def test_large_files_are_cut(spark, tmp_path):
    values = np.arange(2_500_000.0)
    np.save(tmp_path / npy.file_name("forward", 0, 1), values)
    rows = npy.read_chain(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 3
    assert tuple(rows.agg(F.count("*"), F.sum("r2"), F.sum("row"), F.countDistinct("row")).first()) == (2_500_000, values.sum(), int(values.sum()), 2_500_000)


def test_write_commits_or_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(0, 120).select(F.when(F.col("id") % 2 == 0, "forward").otherwise("backward").alias("direction"), (F.col("id") % 3).alias("step"), (F.col("id") % 4).alias("shard"), F.floor(F.col("id") / 12).alias("row"), (F.col("id") * 0.5).alias("r2"))
    npy.write_chain(rows, out)
    back = npy.read_chain(spark, out)
    key = ("direction", "step", "shard", "row", "r2")
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, rows.select(*key).collect()))
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == 12 and not any(f.startswith(".") for f in files)
    with pytest.raises(Exception, match="FileExists"):
        npy.write_chain(rows, out)
    with pytest.raises(Exception, match="are not 0 to"):
        npy.write_chain(rows.where("row <> 2"), str(tmp_path / "holes"))
    assert not [p for p in tmp_path.rglob("*.npy") if "holes" in str(p)]
    with pytest.raises(Exception, match="not mounted"):
        npy.read_chain(spark, "hdfs://somewhere/chains").count()
