"""Kernel sums, hopping tables, spectra and scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import broaden, hopping
from . import bindings as B


def spectral_weight(spark, d):
    out = broaden.spectral_weight(B.bands(spark, d), [3.0, 4.5, 6.0], 0.2)
    return out.select("layer", "layer_value", "i", "j", F.round("v", 6).alias("v"))


def broadened_map(spark, d):
    cells = spark.range(16 * 12).select(F.expr("cast(id div 12 as int)").alias("ik"), F.expr("cast(id % 12 as int)").alias("ie")).withColumns({"gk": F.col("ik") * 10.0, "ge": F.col("ie") * 9.0})
    out = broaden.broadened_map(B.points(spark, d), cells, 15.0, 8.0)
    return out.select("ik", "ie", F.round("a", 4).alias("a"))


def tiled_map(spark, d):
    """The exact sum, and whether the sum by tiles keeps its bound; narrow widths, so that most tiles are far."""
    cells = spark.range(16 * 12).select(F.expr("cast(id div 12 as int)").alias("ik"), F.expr("cast(id % 12 as int)").alias("ie")).withColumns({"gk": F.col("ik") * 10.0, "ge": F.col("ie") * 9.0})
    points = B.points(spark, d)
    exact = broaden.broadened_map(points, cells, 0.5, 0.4)
    tiled = broaden.tiled_map(points, cells, 0.5, 0.4, tol=1e-2).select("ik", "ie", F.col("a").alias("t"))
    return exact.join(tiled, ["ik", "ie"]).select("ik", "ie", F.round("a", 6).alias("a"), (F.abs(F.col("t") - F.col("a")) <= 1e-2 * F.col("a")).alias("within"))


def thermal_chunks(spark, d):
    return broaden.thermal_chunks(B.spectra(spark, d), 0.02, 1e-12, chunk=32).select("spectrum", "p", F.round("v", 6).alias("v"))


def thermal(spark, d):
    return broaden.thermal(B.spectra(spark, d), 0.02).select("spectrum", "p", F.round("v", 6).alias("v"))


def thermal_near(spark, d):
    return broaden.thermal(B.spectra(spark, d), 0.02, reach=6).select("spectrum", "p", F.round("v", 6).alias("v"))


def conductance(spark, d):
    e = B.spectra(spark, d).select("spectrum", "p", F.round(F.col("v") * 10, 3).alias("e"))
    sweep = F.explode(F.array(*[F.struct(F.lit(x).alias("delta"), F.lit(z).alias("z"), F.lit(g).alias("gamma")) for x, z, g in ((1.0, 0.0, 0.0), (0.8, 0.5, 0.02), (1.2, 2.0, 0.1))]))
    e = e.withColumn("s", sweep).select("spectrum", "p", "e", "s.*")
    return e.withColumn("g", F.round(scalar.junction_conductance(F.col("e"), F.col("delta"), F.col("z"), F.col("gamma")), 6))


def bloch_sum(spark, d):
    return hopping.bloch_sum(B.hopping(spark, d), 6).select("i", "j", "m", "n", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


def hermitian_hopping(spark, d):
    return hopping.hermitian(B.hopping(spark, d)).select("r1", "r2", "m", "n", F.round("re", 4).alias("re"), F.round("im", 4).alias("im"), "ndegen")


def hopping_check(spark, d):
    header = spark.createDataFrame([("t", 3, 35)], "system_id string, num_wann int, nrpts int")
    return hopping.complete_check(B.hopping(spark, d), header)


def _packed(spark, d):
    return hopping.packed(hopping.bloch_sum(hopping.hermitian(B.hopping(spark, d)), 6), 3)


def eigen_energies(spark, d):
    return hopping.eigen(_packed(spark, d), 3).select("i", "j", "band", "energy")


def resolvent_spectrum(spark, d):
    return hopping.spectral_matrix(hopping.resolvent(_packed(spark, d), 3, [0.0, 10.0], 0.5)).select("layer", "i", "j", "a", "b", "v")


def catalogue(spark, d):
    p = B.table(spark, d, "part")
    size = F.col("p_size").cast("double")
    return p.select(
        "p_partkey",
        F.round(scalar.window_limit(F.col("p_partkey") % 256 + 1, size), 8).alias("q_limit"),
        F.round(scalar.free_electron(size * 1e8), 8).alias("energy"),
        F.round(scalar.flux_count(F.col("p_retailprice") / 1e3, size * 1e-18), 8).alias("flux"),
        F.round(size * scalar.HARTREE_EV, 6).alias("ev"),
        F.round(size * scalar.BOHR_ANGSTROM, 6).alias("angstrom"),
        F.round(scalar.k_width(size), 8).alias("wk"),
        F.round(scalar.e_width(size), 10).alias("we"),
    )


def folded(spark, d):
    e = B.table(spark, d, "events")
    step = 0.125
    return e.select("event_id", F.round(scalar.wrapped(F.col("value")), 6).alias("wrapped"), scalar.centred(F.col("user_id") % 16, 16, step).alias("centred"))


def occupations(spark, d):
    c = B.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("e"))
    mu = F.lit(4.5)
    return c.select("c_custkey", F.round(scalar.occupation(F.col("e"), mu, F.lit(0.3)), 9).alias("warm"), scalar.occupation(F.col("e"), mu, F.lit(0.0)).alias("cold"), F.round(scalar.lorentzian(F.col("e"), mu, 0.2), 9).alias("line"), F.round(scalar.lorentzian_2d(F.col("e"), F.col("e") - mu, 2.0, 0.5), 9).alias("kernel"))


def grid_dimensions(spark, d):
    p = B.table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("n"), F.col("p_size"))).otherwise(F.concat(F.col("p_size"), F.lit(" x "), F.col("p_partkey") % 7))
    return p.select("p_partkey", text.alias("dim")).withColumns({"nx": scalar.grid_dimension(F.col("dim"), 1), "ny": scalar.grid_dimension(F.col("dim"), 2)})


QUERIES = {
    "a03_p07_spectral_weight": spectral_weight, "a04_j08_broadened_map": broadened_map, "a04_tiled_map": tiled_map, "a12_thermal_chunks": thermal_chunks, "a12_thermal": thermal, "a12_thermal_near": thermal_near, "p12_conductance": conductance,
    "a01_j03_bloch_sum": bloch_sum, "a01_hermitian_hopping": hermitian_hopping, "s06_hopping_check": hopping_check, "a02_eigen_energies": eigen_energies, "a07_a09_resolvent_spectrum": resolvent_spectrum,
    "p03_p13_catalogue": catalogue, "p04_p05_folded": folded, "p06_p08_occupations": occupations, "p15_grid_dimensions": grid_dimensions,
}

_COSH = "(exp({x}) + exp(-({x}))) / 2"


def _thermal(near: int | None) -> str:
    x, y = _COSH.format(x="(a.p - b.p) * 0.01 / 0.04"), _COSH.format(x="k * 0.01 / 0.04")
    reach = f" AND abs(a.p - b.p) <= {near}" if near else ""
    span = f"range(-{near}, {near} + 1)" if near else "range(-63, 64)"
    return f"""WITH {B.SPECTRA_SQL}, n AS (SELECT sum(1 / ({y}) / ({y})) AS norm FROM {span} AS u(k)), t AS (SELECT a.spectrum, a.p, sum(b.v / ({x}) / ({x})) AS s FROM s a JOIN s b ON a.spectrum = b.spectrum{reach} GROUP BY ALL)
SELECT spectrum, p, round(s / norm, 6) AS v FROM t, n"""


_W = {"re": "(e * e - gamma * gamma - delta * delta)", "im": "(2 * e * gamma)"}
SQL = {
    "a03_p07_spectral_weight": f"WITH {B.BANDS_SQL} SELECT CAST(k AS INTEGER) AS layer, CAST(3.0 + 1.5 * k AS DOUBLE) AS layer_value, i, j, round(sum(0.2 / pi() / ((3.0 + 1.5 * k - energy) * (3.0 + 1.5 * k - energy) + 0.04)), 6) AS v FROM e, range(3) AS u(k) GROUP BY ALL",
    "a04_j08_broadened_map": "SELECT CAST(a AS INTEGER) AS ik, CAST(b AS INTEGER) AS ie, round(sum(1 / (1 + ((a * 10.0 - user_id) / 15) * ((a * 10.0 - user_id) / 15) + ((b * 9.0 - value) / 8) * ((b * 9.0 - value) / 8))), 4) AS a FROM events, range(16) AS x(a), range(12) AS y(b) GROUP BY a, b",
    "a04_tiled_map": "SELECT CAST(a AS INTEGER) AS ik, CAST(b AS INTEGER) AS ie, round(sum(1 / (1 + ((a * 10.0 - user_id) / 0.5) * ((a * 10.0 - user_id) / 0.5) + ((b * 9.0 - value) / 0.4) * ((b * 9.0 - value) / 0.4))), 6) AS a, true AS within FROM events, range(16) AS x(a), range(12) AS y(b) GROUP BY a, b",
    "a12_thermal_chunks": _thermal(None),
    "a12_thermal": _thermal(None),
    "a12_thermal_near": _thermal(6),
    "p12_conductance": f"""WITH {B.SPECTRA_SQL}, q(delta, z, gamma) AS (VALUES (1.0, 0.0, 0.0), (0.8, 0.5, 0.02), (1.2, 2.0, 0.1)),
a AS (SELECT spectrum, p, round(s.v * 10, 3) AS e, CAST(delta AS DOUBLE) AS delta, CAST(z AS DOUBLE) AS z, CAST(gamma AS DOUBLE) AS gamma FROM s, q),
b AS (SELECT *, sqrt({_W['re']} * {_W['re']} + {_W['im']} * {_W['im']}) AS h FROM a),
c AS (SELECT *, (CASE WHEN e < 0 THEN -1 ELSE 1 END) * sqrt((h + {_W['re']}) / 2) AS rr, (CASE WHEN e < 0 THEN -1 ELSE 1 END) * (CASE WHEN {_W['im']} < 0 THEN -1 ELSE 1 END) * sqrt(greatest(0, h - {_W['re']}) / 2) AS ri, e * e + gamma * gamma AS w FROM b WHERE abs(e) >= delta),
r AS (SELECT *, (rr * e + ri * gamma) / w AS x, (ri * e - rr * gamma) / w AS y FROM c),
g AS (SELECT *, (1 - (x * x - y * y)) / 4 - (x * x - y * y) * z * z * (1 + z * z) AS tr, -2 * x * y / 4 - 2 * x * y * z * z * (1 + z * z) AS ti, 0.5 + x * (z * z + 0.5) AS gr, y * (z * z + 0.5) AS gi FROM r),
o AS (SELECT spectrum, p, e, delta, z, gamma, 1 + (tr * (gr * gr - gi * gi) + ti * 2 * gr * gi) / ((gr * gr - gi * gi) * (gr * gr - gi * gi) + 4 * gr * gr * gi * gi) AS g FROM g
  UNION ALL SELECT spectrum, p, e, delta, z, gamma, 2 * delta * delta / (e * e + (delta * delta - e * e) * (1 + 2 * z * z) * (1 + 2 * z * z)) FROM a WHERE abs(e) < delta)
SELECT spectrum, p, e, delta, z, gamma, round(g, 6) AS g FROM o""",
    "a01_j03_bloch_sum": f"""WITH {B.HOPPING_SQL}, t AS (SELECT h.*, CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, 2 * pi() * (r1 * (a / 6 - 0.5) + r2 * (b / 6 - 0.5)) AS x FROM h, range(6) AS u(a), range(6) AS w(b))
SELECT i, j, m, n, round(sum((re * cos(x) - im * sin(x)) / ndegen), 3) + 0.0 AS re, round(sum((re * sin(x) + im * cos(x)) / ndegen), 3) + 0.0 AS im FROM t GROUP BY ALL""",
    "a01_hermitian_hopping": f"WITH {B.HOPPING_SQL}, b AS (SELECT r1, r2, m, n, re / 2 AS re, im / 2 AS im, ndegen FROM h UNION ALL SELECT -r1, -r2, n, m, re / 2, -im / 2, ndegen FROM h) SELECT r1, r2, m, n, round(sum(re), 4) + 0.0 AS re, round(sum(im), 4) + 0.0 AS im, max(ndegen) AS ndegen FROM b GROUP BY ALL",
    "s06_hopping_check": f"WITH {B.HOPPING_SQL}, s AS (SELECT count(DISTINCT (r1, r2)) AS r_seen, count(*) AS rows_seen FROM h) SELECT 't' AS system_id, 3 AS num_wann, 35 AS nrpts, r_seen, rows_seen, CAST(0 AS BIGINT) AS bad_rows, r_seen = 35 AND rows_seen = 315 AS ok FROM s",
    "p03_p13_catalogue": f"""SELECT p_partkey, round(pi() * (p_partkey % 256 + 1) / (10 * CAST(p_size AS DOUBLE)), 8) AS q_limit, round({scalar.HBAR**2 / (2 * scalar.ELECTRON_MASS * scalar.ELECTRON_CHARGE)!r} * (p_size * 1e8) * (p_size * 1e8), 8) AS energy,
  round((p_retailprice / 1e3) * (p_size * 1e-18) / 2.067833848e-15, 8) AS flux, round(p_size * 27.211386245988::DOUBLE, 6) AS ev, round(p_size * 0.52917721092::DOUBLE, 6) AS angstrom, round(2 * pi() / (10 * CAST(p_size AS DOUBLE)), 8) AS wk,
  round({math.log(3 + 2 * math.sqrt(2)) * scalar.BOLTZMANN_EV!r}::DOUBLE * p_size, 10) AS we FROM part""",
    "p04_p05_folded": "SELECT event_id, round(value - floor(value + 0.5), 6) AS wrapped, CAST((user_id % 16 - 8) * 0.125 AS DOUBLE) AS centred FROM events",
    "p06_p08_occupations": """WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS e, (c_acctbal / 1000 - 4.5) / 0.3 AS x FROM customer)
SELECT c_custkey, round(CASE WHEN x > 0 THEN exp(-x) / (1 + exp(-x)) ELSE 1 / (1 + exp(x)) END, 9) AS warm, CAST(CASE WHEN e < 4.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS cold,
  round(0.2 / pi() / ((e - 4.5) * (e - 4.5) + 0.2 * 0.2), 9) AS line, round(1 / (1 + (e / 2) * (e / 2) + ((e - 4.5) / 0.5) * ((e - 4.5) / 0.5)), 9) AS kernel FROM c""",
    "p15_grid_dimensions": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'n' || p_size ELSE p_size || ' x ' || (p_partkey % 7) END AS dim, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS nx, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 7 END AS INTEGER) AS ny FROM part",
}
