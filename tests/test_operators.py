"""Operators on small made-up inputs against NumPy, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import broaden, correlate, hopping, lattice, mesh, transform


def layers(spark, arrays):
    rows = [(k, i, j, float(v)) for k, a in enumerate(arrays) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "layer int, i int, j int, v double")


def as_array(df, n, value="v", layer=0):
    out = np.zeros((n, n))
    for r in df.where(F.col("layer") == layer).collect():
        out[r.i, r.j] = r[value]
    return out


@pytest.mark.parametrize("n", [5, 8])
@pytest.mark.parametrize("route", ["pairs", "dft"])
def test_correlation(spark, n, route):
    rng = np.random.default_rng(n)
    a, b = rng.random((2, n, n))
    want = np.fft.ifft2(np.conj(np.fft.fft2(a)) * np.fft.fft2(b)).real
    got = correlate.correlation(layers(spark, [a]), layers(spark, [b]), n, route=route)
    np.testing.assert_allclose(as_array(got, n), want, rtol=1e-9)


def test_autocorrelation_sums_to_square(spark):
    a = np.random.default_rng(1).integers(0, 9, (8, 8)).astype(float)
    g = layers(spark, [a])
    assert correlate.correlation(g, g, 8).agg(F.sum("v")).first()[0] == a.sum() ** 2


@pytest.mark.parametrize("n", [5, 6])
def test_dft_and_back(spark, n):
    a = np.random.default_rng(n).random((n, n))
    g = layers(spark, [a]).select("layer", "i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    t = transform.dft(g, n)
    np.testing.assert_allclose(as_array(t, n, "re") + 1j * as_array(t, n, "im"), np.fft.fft2(a), atol=1e-9)
    np.testing.assert_allclose(as_array(transform.dft(t, n, inverse=True), n, "re"), a, atol=1e-9)
    np.testing.assert_allclose(as_array(transform.fft_layers(g, n), n, "im"), np.fft.fft2(a).imag, atol=1e-9)


@pytest.mark.parametrize("n", [5, 8])
def test_recentre_and_back(spark, n):
    g = layers(spark, [np.arange(n * n).reshape(n, n)])
    np.testing.assert_array_equal(as_array(mesh.recentred(g, n), n), np.fft.fftshift(as_array(g, n)))
    np.testing.assert_array_equal(as_array(mesh.recentred(mesh.recentred(g, n), n, inverse=True), n), as_array(g, n))


@pytest.mark.parametrize(("low", "high"), [(-0.5, 0.5), (-1.0, 1.0), (-0.3, 0.3), (0.1, 1.7)])
def test_extension_counts_and_values(spark, low, high):
    n = 8
    g = layers(spark, [np.arange(n * n).reshape(n, n)])
    first, end = mesh.index_bounds(low, high, n)
    got = mesh.extended(g, n, low, high).collect()
    assert len(got) == (end - first) ** 2
    assert all(r.v == (r.i % n) * n + r.j % n and low <= r.i / n - 0.5 < high for r in got)


def test_crop_of_extension_is_identity(spark):
    g = layers(spark, [np.arange(64).reshape(8, 8)])
    back = mesh.cropped(mesh.extended(g, 8, -1.5, 1.5), 8, -0.5, 0.5)
    np.testing.assert_array_equal(as_array(back, 8), as_array(g, 8))
    assert back.count() == 64


def test_empty_crop_is_an_error(spark):
    with pytest.raises(ValueError):
        mesh.cropped(layers(spark, [np.zeros((4, 4))]), 4, 0.6, 0.9, strict=True)


def test_zero_layer_is_not_normalised(spark):
    g = mesh.normalised(layers(spark, [np.zeros((3, 3)), np.full((3, 3), 4.0)]), out="n")
    assert as_array(g, 3, "n").max() == 0
    assert as_array(g, 3, "n", 1).max() == 1


def test_window_reaches_the_scan(spark, tmp_path):
    layers(spark, [np.arange(256).reshape(16, 16)]).write.parquet(str(tmp_path / "g"))
    plan = mesh.cropped(spark.read.parquet(str(tmp_path / "g")), 16, -0.25, 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,4)" in plan
    assert "LessThan(i,12)" in plan


def test_chain_is_a_cosine(spark):
    rows = [("s", 0, 0, 0, 0, 0, 0.5, 0.0, 1.0), ("s", 1, 0, 0, 0, 0, -1.0, 0.0, 1.0), ("s", -1, 0, 0, 0, 0, -1.0, 0.0, 1.0)]
    h = spark.createDataFrame(rows, "system_id string, r1 int, r2 int, r3 int, m int, n int, re double, im double, ndegen double")
    for r in hopping.bloch_sum(h, 8).collect():
        assert math.isclose(r.re, 0.5 - 2 * math.cos(2 * math.pi * (r.i / 8 - 0.5)), abs_tol=1e-12)
        assert abs(r.im) < 1e-12


@pytest.mark.parametrize("route", ["pairs", "dft"])
def test_scattering_of_a_resolvent(spark, route):
    """The map of G and V equals the direct sum over k."""
    rng = np.random.default_rng(3)
    n = 6
    g = rng.normal(size=(n, n, 2, 2)) + 1j * rng.normal(size=(n, n, 2, 2))
    v = rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))
    rows = [(0, i, j, a, b, float(g[i, j, a, b].real), float(g[i, j, a, b].imag)) for i in range(n) for j in range(n) for a in range(2) for b in range(2)]
    gd = spark.createDataFrame(rows, "layer int, i int, j int, a int, b int, re double, im double")
    vd = spark.createDataFrame([(a, b, float(v[a, b].real), float(v[a, b].imag)) for a in range(2) for b in range(2)], "a int, b int, vre double, vim double")
    want = np.zeros((n, n))
    for q in np.ndindex(n, n):
        moved = np.roll(g, (-q[0], -q[1]), (0, 1))
        want[q] = -np.einsum("xyab,bc,xyca->", g, v, moved).imag / np.pi
    np.testing.assert_allclose(as_array(correlate.scattering_map(gd, vd, n, route=route), n), want, atol=1e-9)


def test_bare_response_with_vectors(spark):
    """chi0 of a two-band model against a direct double loop."""
    rng = np.random.default_rng(4)
    n, mu, kt, eta = 4, 0.1, 0.2, 0.05
    h = rng.normal(size=(n, n, 2, 2)) + 1j * rng.normal(size=(n, n, 2, 2))
    e, u = np.linalg.eigh(h + np.conj(np.swapaxes(h, 2, 3)))
    rows = [(i, j, b, float(e[i, j, b]), u[i, j, :, b].real.tolist(), u[i, j, :, b].imag.tolist()) for i in range(n) for j in range(n) for b in range(2)]
    ed = spark.createDataFrame(rows, "i int, j int, band int, energy double, u_re array<double>, u_im array<double>")
    f = 1 / (1 + np.exp((e - mu) / kt))
    want = np.zeros((n, n), complex)
    for q in np.ndindex(n, n):
        e2, u2, f2 = (np.roll(x, (-q[0], -q[1]), (0, 1)) for x in (e, u, f))
        overlap = np.abs(np.einsum("xyom,xyon->xymn", np.conj(u), u2)) ** 2
        want[q] = -(overlap * (f[..., :, None] - f2[..., None, :]) / (e[..., :, None] - e2[..., None, :] + 1j * eta)).sum() / n**2
    got = {(r.i, r.j): r.re + 1j * r.im for r in correlate.bare_response(ed, n, mu, kt, eta).collect()}
    np.testing.assert_allclose([got[q] for q in np.ndindex(n, n)], want.reshape(-1), atol=1e-9)


def test_thermal_is_a_convolution(spark):
    e = np.linspace(-1, 1, 41)
    v = np.exp(-e * e) * (1 + e)
    kt = 0.1
    far = np.arange(-40, 41) * 0.05
    bell = 1 / (4 * kt) / np.cosh(far / (2 * kt)) ** 2
    want = np.convolve(v, bell)[40:81] / bell.sum()
    s = spark.createDataFrame([(1, p, float(x), float(y)) for p, (x, y) in enumerate(zip(e, v, strict=True))], "spectrum int, p int, e double, v double")
    got = [r.v for r in broaden.thermal(s, kt).orderBy("p").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_conductance_limits(spark):
    """Perfect contact doubles below the gap; a strong barrier suppresses it; far above it is 1 without barrier."""
    df = spark.createDataFrame([(0.5, 1.0, 0.0), (0.0, 1.0, 5.0), (50.0, 1.0, 0.0)], "e double, d double, z double")
    g = [r[0] for r in df.select(scalar.junction_conductance(F.col("e"), F.col("d"), F.col("z"))).collect()]
    assert math.isclose(g[0], 2.0)
    assert g[1] < 0.001
    assert math.isclose(g[2], 1.0, abs_tol=1e-3)


def test_temperature_is_checked(spark):
    with pytest.raises(Exception, match="temperature outside"):
        spark.range(1).select(scalar.e_width(F.lit(0.01))).collect()


LATTICES = {"square": [(1, 0, 0), (0, 1, 0), (0, 0, 1)], "hex60": [(1, 0, 0), (0.5, math.sqrt(0.75), 0), (0, 0, 3)], "hex120": [(1, 0, 0), (-0.5, math.sqrt(0.75), 0), (0, 0, 3)], "skew": [(2, 0.3, 0.1), (0.4, 1.5, -0.2), (0.1, 0.7, 3)]}


def vectors(spark):
    return spark.createDataFrame([(s, k + 1, *map(float, v)) for s, m in LATTICES.items() for k, v in enumerate(m)], "system_id string, axis int, x double, y double, z double")


def test_duality_and_round_trip(spark):
    for r in lattice.checks(lattice.wide(vectors(spark))).collect():
        assert r.duality_error < 1e-9
        assert r.round_trip_error < 1e-9
        assert math.isclose(r.volume * r.dual_volume, (2 * math.pi) ** 3)


def test_singular_basis_is_an_error(spark):
    bad = spark.createDataFrame([("s", k, 1.0, 0.0, 0.0) for k in (1, 2, 3)], "system_id string, axis int, x double, y double, z double")
    with pytest.raises(Exception, match="singular"):
        lattice.dual(lattice.wide(bad)).collect()


def test_subcell_of_supercell(spark):
    m = [[2, 1], [-1, 1]]
    back = lattice.transformed(lattice.transformed(vectors(spark), lattice.matrix(spark, m)), lattice.matrix(spark, m, inverse=True))
    for r in back.collect():
        np.testing.assert_allclose((r.x, r.y, r.z), LATTICES[r.system_id][r.axis - 1], atol=1e-12)


def test_plane_basis_and_orders(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 2.0)], "system_id string, b1x double, b1y double, b2x double, b2y double")
    assert [(r.axis, r.x, r.y, r.z) for r in lattice.from_plane(rows).orderBy("axis").collect()] == [(1, 1, 0, 0), (2, 0, 2, 0), (3, 0, 0, 1)]
    norms = [r.norm for r in lattice.bragg_in_circle(rows, 2.1, origin=True, ordered=True).collect()]
    assert norms == sorted(norms)
    assert len(norms) == 7
    half = rows.withColumns({"s1x": F.lit(0.5), "s1y": F.lit(0.0), "s2x": F.lit(0.0), "s2y": F.lit(1.0)})
    got = [(r.u, r.v, abs(r.m) + abs(r.n)) for r in lattice.bragg_folded(half, 2, ordered=True).collect()]
    assert got == [(-0.5, -0.5, 2), (-0.5, 0.0, 1), (0.0, -0.5, 1), (0.0, 0.0, 0)]


def test_zone_needs_six_vectors(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 0.2, 0.9)], "system_id string, b1x double, b1y double, b2x double, b2y double")
    assert lattice.orbit(rows).count() == 12
    assert lattice.zone_vertices(rows).count() == 6


def test_polygon_edges_and_vertices(spark):
    hexagon = [(math.cos(math.pi * k / 3), math.sin(math.pi * k / 3)) for k in range(6)]
    pts = [(0.0, 0.0, True), (*hexagon[1], True), (0.75, math.sqrt(0.75) / 2, True), (0.95, 0.3, False), (0.0, math.sqrt(0.75), True), (-2.0, 0.0, False), (1.5, 0.0, False)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean")
    assert all(r.want == r.inside for r in lattice.polygon_mask(df, hexagon).collect())


def test_no_join_on_nothing(spark):
    """With broadcasting off, no plan of the all-pairs operators holds a cartesian product."""
    from tessera.operators import broaden, correlate

    m = spark.createDataFrame([(0, 0, 0, i, j, float(i + j), 1.0) for i in range(4) for j in range(4)], "layer int, a int, b int, i int, j int, v double, w double")
    w = spark.createDataFrame([(0, 0, 1.0)], "a int, b int, w double")
    e = m.selectExpr("i", "j", "0 as band", "v as energy", "array(1.0D) as u_re", "array(0.0D) as u_im")
    cells = m.selectExpr("i as ik", "j as ie", "v as gk", "v as ge")
    points = m.selectExpr("v as k0", "v as e0", "w")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (correlate.pair_map(m.drop("w"), m.drop("w"), w, w, 4, 1.0), correlate.bare_response(e, 4, 3.0, 0.1, 0.05), correlate.correlation(m, m, 4), broaden.broadened_map(points, cells, 1.0, 1.0)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan
            assert "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pair_map_by_either_route(spark):
    from tessera.operators import correlate

    rows = [(layer, a, b, i, j, float((layer + 2 * a + 3 * b + i * j + i) % 7)) for layer in range(2) for a in range(2) for b in range(2) for i in range(5) for j in range(5)]
    m = spark.createDataFrame(rows, "layer int, a int, b int, i int, j int, v double")
    w = spark.createDataFrame([(a, b, 1.0 + a - 0.5 * b) for a in range(2) for b in range(2)], "a int, b int, w double")
    one, two = ({(r.i, r.j): r.v for r in correlate.pair_map(m, m, w, w, 5, -0.5, route=route).collect()} for route in ("pairs", "dft"))
    assert one.keys() == two.keys()
    assert all(abs(one[k] - two[k]) < 1e-8 for k in one)


def test_two_systems_stay_apart(spark):
    from tessera.operators import broaden, mesh

    e = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("b", 0, 0, 0, 1.0), ("b", 0, 0, 1, 1.0)], "system_id string, i int, j int, band int, energy double")
    got = {r.system_id: r.v for r in broaden.spectral_weight(e, [1.0], 0.5).collect()}
    assert got["b"] == pytest.approx(2 * got["a"])
    grid = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "system_id string, i int, j int")
    bases = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 1.0), ("b", 2.0, 0.0, 0.0, 2.0)], "system_id string, b00 double, b01 double, b10 double, b11 double")
    assert {r.system_id: (r.x, r.y) for r in mesh.placed(grid, 2, bases).collect()} == {"a": (0.0, -0.5), "b": (0.0, -1.0)}
    with pytest.raises(Exception, match="several bases"):
        mesh.placed(grid.drop("system_id"), 2, bases.drop("system_id")).collect()
