"""Stored blocks of voxels against single voxels."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import voxel

SCHEMA = "i int, j int, k int, value double"


def cube(spark, n, seed, rate=1.0):
    """An n x n x n cube of whole numbers, a share of it only."""
    axis = lambda c, p: (F.floor(F.col("id") / p) % n).cast("int").alias(c)
    each = spark.range(n**3).select(axis("i", n * n), axis("j", n), axis("k", 1), F.pmod(F.hash("id", F.lit(seed)), F.lit(1000)).cast("double").alias("value"))
    return each.where(F.pmod(F.hash("i", "j", "k", F.lit(seed)), F.lit(100)) < 100 * rate)


def rows(df):
    return sorted(tuple(r) for r in df.select("i", "j", "k", "value").collect())


@pytest.mark.parametrize("side", [1, 3, 16])
def test_round_trip(spark, side):
    v = cube(spark, 10, 1, 0.7).unionByName(spark.createDataFrame([(100_000, 2_000_000 * side // 16, 7, 1.5)], SCHEMA))
    made = voxel.blocks(v, side=side)
    assert made.where(F.size("values") != side**3).count() == 0
    assert rows(voxel.unblocked(made, side=side)) == rows(v)


def test_difference_of_stored_blocks_does_not_shuffle(spark, tmp_path):
    a, b = cube(spark, 36, 1), cube(spark, 36, 2, 0.5)
    names = []
    for n, v in enumerate((a, b)):
        names.append("vox_" + uuid.uuid4().hex)
        voxel.save_blocks(voxel.blocks(v), names[-1], str(tmp_path / str(n)), 4)
    met = voxel.block_difference(spark.table(names[0]), spark.table(names[1]))
    assert rows(voxel.unblocked(met)) == rows(voxel.difference(a, b))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    size = sum(f.stat().st_size for f in (tmp_path / "0").glob("*.parquet"))
    a.write.parquet(str(tmp_path / "plain"))
    assert spark.table(names[0]).count() == 27  # in place of 46,656 rows
    assert size < 46_656 * 8
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_odd_rows(spark):
    assert voxel.blocks(spark.createDataFrame([], SCHEMA)).count() == 0
    v = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, float("nan"))], SCHEMA)
    back = voxel.unblocked(voxel.blocks(v)).collect()
    assert len(back) == 1 and back[0].k == 1 and back[0].value != back[0].value
    for bad, text in (([(0, 0, 0, 1.0), (0, 0, 0, 2.0)], "twice"), ([(0, -1, 0, 1.0)], "negative"), ([(0, None, 0, 1.0)], "negative")):
        with pytest.raises(Exception, match=text):
            voxel.blocks(spark.createDataFrame(bad, SCHEMA)).collect()
    keyed = cube(spark, 4, 1).withColumn("cube_id", F.lit("x")).unionByName(cube(spark, 4, 2).withColumn("cube_id", F.lit("y")))
    assert voxel.unblocked(voxel.blocks(keyed, ["cube_id"], 4), ["cube_id"], 4).exceptAll(keyed.select("cube_id", "i", "j", "k", "value")).count() == 0
