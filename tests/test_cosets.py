"""Folded points by cosets against a search, and equality within a tolerance."""

import math

import numpy as np
import pytest

from tessera.operators import lattice

S1, S2 = (0.7, 0.1), (-0.2, 0.9)


def rows(spark, matrices):
    made = []
    for k, (a, b, c, d) in enumerate(matrices):
        made.append((str(k), a * S1[0] + b * S2[0], a * S1[1] + b * S2[1], c * S1[0] + d * S2[0], c * S1[1] + d * S2[1], *S1, *S2))
    return spark.createDataFrame(made, "system_id string, " + ", ".join(f"{v}{c} double" for v in ("b1", "b2", "s1", "s2") for c in "xy"))


def search(a, b, c, d, reach):
    """The smallest |m| + |n| (then m, n) of each folded point, over all numbers up to reach."""
    det, best = a * d - b * c, {}
    for m in range(-reach, reach + 1):
        for n in range(-reach, reach + 1):
            u, v = m * d - n * c, n * a - m * b
            key = (u * (1 if det > 0 else -1) % abs(det), v * (1 if det > 0 else -1) % abs(det))
            best[key] = min(best.get(key, (99, 0, 0)), (abs(m) + abs(n), m, n))
    return {(m, n) for _, m, n in best.values()}


def test_all_small_matrices(spark):
    """Every whole-number matrix with entries up to 4, of either sign in its first row."""
    span = range(-4, 5)
    matrices = [(a, b, c, d) for a in span for b in span for c in range(5) for d in span if a * d - b * c]
    found = {}
    for r in lattice.folded_cosets(rows(spark, matrices)).collect():
        found.setdefault(int(r.system_id), set()).add((r.m, r.n))
    assert len(found) == len(matrices)
    for k, m in enumerate(matrices):
        assert found[k] == search(*m, 6), m


def test_long_cells(spark):
    """Cells far longer than wide, and a thousand points."""
    matrices = [(25, 40, 0, 1), (1, 0, 37, 30), (31, 7, -3, 33), (100, 1, 1, 10)]
    found = {}
    for r in lattice.folded_cosets(rows(spark, matrices)).collect():
        found.setdefault(int(r.system_id), set()).add((r.m, r.n))
    for k, m in enumerate(matrices):
        assert found[k] == search(*m, 70), m


def test_folded_places_and_errors(spark):
    got = {(r.m, r.n): (r.u, r.v) for r in lattice.folded_cosets(rows(spark, [(2, 0, 0, 2)])).collect()}
    assert got == {(0, 0): (0.0, 0.0), (-1, 0): (-0.5, 0.0), (0, -1): (0.0, -0.5), (-1, -1): (-0.5, -0.5)}
    for bad, text in (((1.5, 0, 0, 1), "whole-number"), ((1, 2, 2, 4), "determinant")):
        with pytest.raises(Exception, match=text):
            lattice.folded_cosets(rows(spark, [bad])).collect()


def test_orbits_at_the_borders_of_bins(spark):
    """Hexagonal lattices whose coordinates lie half way between multiples of the tolerance have six vectors."""
    rng = np.random.default_rng(9)
    made = []
    for k in range(1000):
        x, y = (float((rng.integers(1, 10**6) + 0.5) * 1e-6) for _ in "xy")
        c, s = math.cos(math.pi / 3), math.sin(math.pi / 3)
        made.append((k, x, y, x * c - y * s, x * s + y * c))
    df = spark.createDataFrame(made, "system_id int, b1x double, b1y double, b2x double, b2y double")
    counts = lattice.orbit(df).groupBy("system_id").count().where("count <> 6")
    assert counts.count() == 0
