"""Sums by tiles and by bins against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import broaden, correlate, hopping, transform


@pytest.mark.parametrize(("tol", "side"), [(1e-2, 1.0), (1e-3, 0.5)])
def test_tiled_map_keeps_its_bound(spark, tol, side):
    rng = np.random.default_rng(4)
    pts = np.concatenate((rng.normal((20, 30), 3, (300, 2)), rng.uniform(-60, 160, (500, 2)), np.repeat([[5.0, 5.0]], 50, 0)))
    w = rng.random(len(pts))
    gk, ge = np.linspace(-50, 150, 9), np.linspace(-40, 140, 7)
    points = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(pts, w, strict=True)], "k0 double, e0 double, w double")
    cells = spark.createDataFrame([(i, j, float(x), float(y)) for i, x in enumerate(gk) for j, y in enumerate(ge)], "ik int, ie int, gk double, ge double")
    got = {(r.ik, r.ie): r.a for r in broaden.tiled_map(points, cells, 1.5, 0.8, tol=tol, side=side).collect()}
    far = broaden.near_tiles(side, tol) * side
    assert far < 60  # most tiles are far
    for i, x in enumerate(gk):
        for j, y in enumerate(ge):
            want = (w / (1 + ((x - pts[:, 0]) / 1.5) ** 2 + ((y - pts[:, 1]) / 0.8) ** 2)).sum()
            assert abs(got[i, j] - want) <= tol * want
    exact = {(r.ik, r.ie): r.a for r in broaden.broadened_map(points, cells, 1.5, 0.8).collect()}
    assert got.keys() == exact.keys()


def test_tiled_map_without_points(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0)], "ik int, ie int, gk double, ge double")
    assert broaden.tiled_map(spark.createDataFrame([], "k0 double, e0 double, w double"), cells, 1.0, 1.0).count() == 0


def bands(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for j in range(n):
            h = np.array([[np.cos(2 * np.pi * i / n) * 2, 0.4 + 0.2j], [0.4 - 0.2j, np.sin(2 * np.pi * j / n) - 0.5]])
            e, u = np.linalg.eigh(h)
            rows += [(i, j, b, float(e[b]), u[:, b].real.tolist(), u[:, b].imag.tolist()) for b in (0, 1)]
    return rows, rng


@pytest.mark.parametrize("kt", [0.2, 0.0])
def test_binned_response(spark, kt):
    """Exact for energies that stand in the middles of bins; for others the error falls with the bins' width."""
    n = 6
    rows, _ = bands(n)
    schema = "i int, j int, band int, energy double, u_re array<double>, u_im array<double>"
    value = lambda df: np.array([[r.re, r.im] for r in df.orderBy("i", "j").collect()])
    placed = spark.createDataFrame([(i, j, b, float((np.floor(e / 0.1) + 0.5) * 0.1), x, y) for i, j, b, e, x, y in rows], schema)
    want = value(correlate.bare_response(placed, n, 0.1, kt, 0.3, 0.05))
    np.testing.assert_allclose(value(correlate.binned_response(placed, n, 0.1, kt, 0.3, 0.05, 0.1)), want, atol=1e-9)
    if kt:
        free = spark.createDataFrame(rows, schema)
        want = value(correlate.bare_response(free, n, 0.1, kt, 0.3))
        off = [np.abs(value(correlate.binned_response(free, n, 0.1, kt, 0.3, width=h)) - want).max() for h in (0.4, 0.1, 0.02)]
        assert off[0] > off[1] > off[2] and off[2] < 0.05 * np.abs(want).max()


def test_binned_response_of_two_systems(spark):
    n = 4
    rows, _ = bands(n)
    schema = "system_id string, i int, j int, band int, energy double, u_re array<double>, u_im array<double>"
    both = spark.createDataFrame([("a", *r) for r in rows] + [("b", r[0], r[1], r[2], r[3] + 1.0, r[4], r[5]) for r in rows], schema)
    got = correlate.binned_response(both, n, 0.1, 0.2, 0.3, width=0.1)
    for s in ("a", "b"):
        own = correlate.binned_response(both.where(F.col("system_id") == s).drop("system_id"), n, 0.1, 0.2, 0.3, width=0.1)
        want = {(r.i, r.j): r.re for r in own.collect()}
        have = {(r.i, r.j): r.re for r in got.where(F.col("system_id") == s).collect()}
        assert want.keys() == have.keys() and all(abs(want[k] - have[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(("n", "n1"), [(64, 8), (72, 8), (66, 6), (67, 1)])
def test_four_step_transform(spark, n, n1):
    assert transform._factor(n) == n1
    rng = np.random.default_rng(n)
    a = np.zeros((2, n, n), complex)
    rows = []
    for _ in range(150):
        k, i, j = int(rng.integers(2)), int(rng.integers(n)), int(rng.integers(n))
        if not a[k, i, j]:
            a[k, i, j] = complex(*rng.normal(size=2))
            rows.append((k, i, j, float(a[k, i, j].real), float(a[k, i, j].imag)))
    g = spark.createDataFrame(rows, "layer int, i int, j int, re double, im double")
    for inverse in (False, True):
        got = np.zeros((2, n, n), complex)
        for r in transform.dft(g, n, inverse=inverse).collect():
            got[r.layer, r.i, r.j] = complex(r.re, r.im)
        np.testing.assert_allclose(got, (np.fft.ifft2 if inverse else np.fft.fft2)(a), atol=1e-9)


def test_packed_matrices(spark, monkeypatch):
    monkeypatch.setattr(hopping, "ELEMENTS", 40)
    rng = np.random.default_rng(6)
    rows = [("s", k, 0, int(c) // 4, int(c) % 4, float(rng.random()), float(rng.random())) for k in range(9) for c in rng.permutation(16)[: 1 + 2 * k % 16]]
    df = spark.createDataFrame(rows, "system_id string, i int, j int, m int, n int, re double, im double")
    want = np.zeros((9, 16), complex)
    for _, k, _, m, n, x, y in rows:
        want[k, 4 * m + n] = complex(x, y)
    got = hopping.packed(df, 4).collect()
    assert len(got) == 9
    for r in got:
        np.testing.assert_array_equal(np.array(r.re) + 1j * np.array(r.im), want[r.i])
    with pytest.raises(Exception, match="twice"):
        hopping.packed(df.union(df), 4).collect()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 14])
def test_thermal_chunks(spark, chunk):
    """Equal to the full sum within the bound, for several lengths, with a point missing."""
    rng = np.random.default_rng(2)
    rows = [(s, p, 0.01 * p - 1, float(rng.normal())) for s, n in ((1, 150), (2, 40), (3, 1)) for p in range(n) if (s, p) != (1, 70)]
    df = spark.createDataFrame(rows, "spectrum int, p int, e double, v double")
    want = {(r.spectrum, r.p): r.v for r in broaden.thermal(df.where("spectrum <> 1"), 0.02).collect()}
    got = {(r.spectrum, r.p): r.v for r in broaden.thermal_chunks(df, 0.02, 1e-8, chunk=chunk).collect()}
    top = max(abs(r[3]) for r in rows)
    assert got.keys() == {r[:2] for r in rows}
    assert all(abs(got[k] - want[k]) <= 2e-8 * top for k in want)
    reach = broaden.thermal_reach(0.01, 0.02, 1e-8)
    bell = lambda d: 1 / np.cosh(d / 0.04) ** 2
    own = {r[1]: r[3] for r in rows if r[0] == 1}
    for p in (0, 69, 71, 149):
        full = sum(v * bell(0.01 * (p - q)) for q, v in own.items()) / sum(bell(0.01 * d) for d in range(-149, 150))
        assert abs(got[1, p] - full) < 1e-3  # the missing point leaves the mean step a little off
    assert 20 < reach < 80


def test_long_spectrum_is_many_chunks(spark):
    df = spark.range(60_000).selectExpr("1 as spectrum", "cast(id as int) as p", "id * 0.001 as e", "if(id = 30000, 1.0D, 0.0D) as v")
    out = broaden.thermal_chunks(df, 0.002, 1e-10, chunk=4096)
    near = {r.p: r.v for r in out.where("p between 29990 and 30010").collect()}
    norm = sum(1 / np.cosh(0.001 * d / 0.004) ** 2 for d in range(-200, 201))
    assert all(abs(v - 1 / np.cosh(0.001 * (p - 30000) / 0.004) ** 2 / norm) < 1e-9 for p, v in near.items())
    assert out.count() == 60_000
