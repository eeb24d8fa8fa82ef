"""Versions of the result store, and systems that are kept apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import correlate, mesh
from tessera.sources import store


def grid(spark, layers, v=1.0, n=2):
    return spark.createDataFrame([(layer, i, j, v) for layer in layers for i in range(n) for j in range(n)], "layer int, i int, j int, v double")


def test_saving_again_leaves_no_stale_layers(spark, tmp_path):
    path = str(tmp_path / "s")
    first = store.save(grid(spark, range(4)), path, "r", "grid", 2)
    store.save(grid(spark, [7]), path, "other", "grid", 2)
    store.save(grid(spark, range(2), 5.0), path, "r", "grid", 2, extra={"a": "b"})
    assert {r.layer for r in store.load(spark, path, "r").collect()} == {0, 1}
    assert {r.v for r in store.load(spark, path, "r").collect()} == {5.0}
    assert {r.layer for r in store.load(spark, path, "r", version=first).collect()} == {0, 1, 2, 3}
    row = store.runs(spark, path).where("run_id = 'r'").first()
    assert (row.layers, row.cells, row.i_low, row.i_high, row.extra) == ([0, 1], 8, 0, 1, {"a": "b"})
    assert store.prune(spark, path, "r") == [first]
    assert store.load(spark, path, "r").count() == 8
    assert store.load(spark, path, "other").count() == 4
    with pytest.raises(ValueError):
        store.load(spark, path, "none")


def test_a_save_that_fails_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.save(grid(spark, range(3)), path, "r", "grid", 2)
    broken = grid(spark, range(3), 9.0).withColumn("v", F.when(F.col("layer") == 2, F.raise_error("lost").cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, path, "r", "grid", 2)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))  # all files written, nothing published
    with pytest.raises(RuntimeError, match="killed"):
        store.save(grid(spark, range(1), 9.0), path, "r", "grid", 2)
    got = store.load(spark, path, "r").collect()
    assert len(got) == 12 and {r.v for r in got} == {1.0}


def _two_systems(spark, n=4):
    rng = np.random.default_rng(5)
    a = {s: rng.random((2, n, n)) for s in ("x", "y")}
    rows = [(s, k, i, j, float(v)) for s, m in a.items() for (k, i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "system_id string, layer int, i int, j int, v double")


def _same(both, single, keys, values):
    """The rows of each system in a joint run equal those of a run of its own."""
    for s in ("x", "y"):
        one = {tuple(r[k] for k in keys): [r[v] for v in values] for r in single(s).collect()}
        got = {tuple(r[k] for k in keys): [r[v] for v in values] for r in both.where(F.col("system_id") == s).collect()}
        assert one.keys() == got.keys() and len(one)
        for k in one:
            np.testing.assert_allclose(got[k], one[k], atol=1e-9)


@pytest.mark.parametrize("route", ["pairs", "dft"])
def test_maps_of_two_systems(spark, route):
    n = 4
    g = _two_systems(spark, n).cache()
    own = lambda s: g.where(F.col("system_id") == s).drop("system_id")
    _same(correlate.joint_density(g, n, route=route), lambda s: correlate.joint_density(own(s), n, route=route), ["layer", "i", "j"], ["v"])
    auto = lambda x: correlate.autocorrelation_map(x, n, -0.5, 0.5, route=route)
    _same(auto(g), lambda s: auto(own(s)), ["layer", "i", "j"], ["raw", "norm"])
    green = g.select("system_id", F.lit(0).alias("layer"), "i", "j", F.lit(0).alias("a"), F.col("layer").alias("b"), F.col("v").alias("re"), (-F.col("v")).alias("im"))
    green = green.unionByName(green.withColumn("a", F.lit(1)).withColumn("re", F.col("re") * 2))
    v = spark.createDataFrame([(0, 0, 1.0, 0.5), (1, 1, -1.0, 0.0), (0, 1, 0.3, 0.0)], "a int, b int, vre double, vim double")
    scatter = lambda x: correlate.scattering_map(x, v, n, route=route)
    only = lambda s: green.where(F.col("system_id") == s).drop("system_id")
    _same(scatter(green), lambda s: scatter(only(s)), ["layer", "i", "j"], ["v"])
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.5)], "a int, b int, w double")
    spectral = green.select("system_id", "layer", "a", "b", "i", "j", F.col("re").alias("v"))
    pair = lambda x: correlate.pair_map(x, x, w, w, n, -0.5, route=route)
    _same(pair(spectral), lambda s: pair(spectral.where(F.col("system_id") == s).drop("system_id")), ["i", "j"], ["v"])


def test_response_of_two_systems(spark):
    n = 4
    e = _two_systems(spark, n).select("system_id", "i", "j", F.col("layer").alias("band"), F.col("v").alias("energy"), F.array(F.lit(1.0), F.col("v")).alias("u_re"), F.array(F.lit(0.0), F.lit(0.2)).alias("u_im")).cache()
    response = lambda x: correlate.bare_response(x, n, 0.5, 0.1, 0.05)
    _same(response(e), lambda s: response(e.where(F.col("system_id") == s).drop("system_id")), ["i", "j"], ["re", "im"])
    with pytest.raises(ValueError, match="system_id"):
        correlate.pair_map(e, e.drop("system_id"), e, e, n, 1.0)


def test_extents(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 2.0, 5)], "k string, v double, u int")
    assert sorted(map(tuple, mesh.extents(df, ["k"], "v", "u").collect())) == [("a", 1.0, 3.0, 2, 1), ("b", 2.0, 2.0, 1, 1)]
