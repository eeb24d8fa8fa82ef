"""Every reference query against its SQL, and those without SQL against NumPy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.queries import QUERIES, SQL, bindings


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["layer", "i", "j", "raw", "norm"]
    assert df.count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _matrices(spark, sf, nk=6):
    """H(k) by a plain double loop over the hopping table."""
    h = np.zeros((nk, nk, 3, 3), complex)
    for r in bindings.hopping(spark, sf).collect():
        for i in range(nk):
            for j in range(nk):
                phase = np.exp(2j * np.pi * (r.r1 * (i / nk - 0.5) + r.r2 * (j / nk - 0.5)))
                v = (r.re + 1j * r.im) / r.ndegen * phase / 2
                h[i, j, r.m, r.n] += v
                h[i, j, r.n, r.m] += np.conj(v)
    return h


def test_eigen_energies(spark, sf):
    want = np.linalg.eigvalsh(_matrices(spark, sf))
    got = np.full(want.shape, np.nan)
    for r in QUERIES["a02_eigen_energies"](spark, sf).collect():
        got[r.i, r.j, r.band] = r.energy
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_resolvent_spectrum(spark, sf):
    h = _matrices(spark, sf)
    for layer, e in enumerate((0.0, 10.0)):
        want = -np.linalg.inv((e + 0.5j) * np.eye(3) - h).imag / np.pi
        got = np.full(want.shape, np.nan)
        for r in QUERIES["a07_a09_resolvent_spectrum"](spark, sf).where(f"layer = {layer}").collect():
            got[r.i, r.j, r.a, r.b] = r.v
        np.testing.assert_allclose(got, want, atol=1e-8)
