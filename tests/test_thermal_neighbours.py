"""Thermal broadening limited to neighbours: by numbers, whatever is missing or repeated, and across chunks."""

import math

import pytest

from tessera.operators import broaden
from tessera.queries import QUERIES


def test_neighbours_across_chunks(spark):
    rows = [("a", p, p / 10, math.sin(p)) for p in range(-9, 40) if p not in (3, 4)] + [("a", 7, 0.7, 2.0), ("b", 0, 0.0, 1.0), ("b", 5, 0.5, None)]
    spectra = spark.createDataFrame(rows, "spectrum string, p int, e double, v double")
    want = sorted((k, p, e, f) for k, p, e, _ in rows for j, q, f, _ in rows if k == j and abs(p - q) <= 2)
    for chunk in (1, 8, 4096):
        got = broaden._neighbours(spectra, 2, "spectrum", chunk).select("spectrum", "p0", "e0", "e").collect()
        assert sorted(map(tuple, got)) == want


def test_sums_of_neighbours_are_not_shuffled_by_pair(spark, sf):
    plan = QUERIES["a12_thermal_near"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "rangeframe" in plan.lower()  # the norm of a spectrum


def test_thermal_of_neighbours(spark):
    spectra = spark.createDataFrame([("a", p, p / 100, float(p % 5)) for p in range(30) if p != 12], "spectrum string, p int, e double, v double")
    bell = lambda d: 1 / (4 * 0.02) / math.cosh(d / 0.04) ** 2
    rows = {r.p: r for r in spectra.collect()}
    norm = sum(bell(k * 0.29 / 28) for k in range(-3, 4))
    for r in broaden.thermal(spectra, 0.02, 3).collect():
        assert r.v == pytest.approx(sum(rows[q].v * bell(r.e - rows[q].e) for q in range(r.p - 3, r.p + 4) if q in rows) / norm, rel=1e-12)
