"""Mesh and transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, mesh, transform
from ..plans import scratch
from ..sources import store
from . import bindings as B

N = 16
#: A mesh with cells that have no row.
FINE = 128
#: A mesh whose axes are long enough for transforms in four steps.
STEPPED = 64
WITH = "WITH " + B.grid_sql(N)
FULL = f"{WITH}, {B.full_sql(N)}"


def autocorrelation_map(spark, d):
    return correlate.autocorrelation_map(B.grid(spark, d, N), N, -0.25, 0.25)


_CORR = f"c AS (SELECT a.layer, (((b.i - a.i) % {N}) + {N}) % {N} AS i, (((b.j - a.j) % {N}) + {N}) % {N} AS j, sum(a.v * b.v) AS v FROM f a JOIN f b ON a.layer = b.layer GROUP BY ALL), r AS (SELECT layer, (i + {N // 2}) % {N} AS i, (j + {N // 2}) % {N} AS j, v, max(v) OVER (PARTITION BY layer) AS top FROM c)"


def correlation_by_dft(spark, d):
    full = mesh.complete(B.grid(spark, d, N), N)
    return correlate.correlation(full, full, N, route="dft").select("layer", "i", "j", F.round("v", 2).alias("v"))


def joint_density(spark, d):
    basis = spark.createDataFrame([(1.0, 0.0, -0.5, 0.75)], "b00 double, b01 double, b10 double, b11 double")
    return correlate.joint_density(B.grid(spark, d, N), N, (-0.75, 0.75), basis).select("layer", "i", "j", F.round("v", 9).alias("v"), "x", "y")


def complete_mesh(spark, d):
    return mesh.complete(B.grid(spark, d, FINE), FINE, fill=None).withColumns({"u": mesh.coordinate(F.col("i"), FINE), "w": mesh.coordinate(F.col("j"), FINE)})


def energy_axes(spark, d):
    sizes = B.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return mesh.energy_axes(sizes, "size", 2.0).select("p_partkey", "m", "energy", "shifted")


def extended(spark, d):
    return mesh.extended(B.grid(spark, d, N), N, -1.0, 0.75)


def cropped(spark, d):
    return mesh.cropped(B.grid(spark, d, N), N, -0.3, 0.3, strict=True)


def recentred(spark, d):
    return mesh.recentred(B.grid(spark, d, N), N)


def recentred_back(spark, d):
    return mesh.recentred(mesh.rolled(B.grid(spark, d, N), N, 3, -5), N, inverse=True)


def normalised(spark, d):
    return mesh.normalised(B.grid(spark, d, N), out="norm")


def flipped(spark, d):
    pixels = B.grid(spark, d, N).select(F.when(F.col("layer") % 2 == 0, "bwd").otherwise("fwd").alias("direction"), "layer", F.col("i").alias("row"), F.col("j").alias("col"), "v")
    return mesh.flipped(pixels, N, N)


def fourier(spark, d):
    g = B.grid(spark, d, N).select("layer", "i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return transform.dft(g, N).select("layer", "i", "j", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


def fourier_layers(spark, d):
    g = B.grid(spark, d, N).select("layer", "i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return transform.fft_layers(g, N).select("layer", "i", "j", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


def placed(spark, d):
    basis = spark.createDataFrame([(1.5, 0.25, -0.5, 2.0)], "b00 double, b01 double, b10 double, b11 double")
    return mesh.placed(B.grid(spark, d, N), N, basis).select("layer", "i", "j", "v", "x", "y")


def target_mesh(spark, d):
    out = mesh.spanned(B.points(spark, d), 16, 12, "k0", "e0")
    return out.select("ik", "ie", F.round("gk", 6).alias("gk"), F.round("ge", 6).alias("ge"))


def stored_layers(spark, d):
    path = scratch.new_folder(spark, "store")
    store.save(B.grid(spark, d, N), path, "t", "grid", N, [float(x) for x in range(1, 8)])
    return store.load(spark, path, "t", layers=[2, 5], window=(-0.5, 1.0)).select("run_id", "layer", "i", "j", "v")


def scattering(spark, d):
    v = spark.createDataFrame([(0, 0, 1.0, 0.0), (0, 1, 0.0, 2.0), (1, 0, 0.0, -2.0), (1, 1, 3.0, 0.0)], "a int, b int, vre double, vim double")
    return correlate.scattering_map(B.matrices(spark, d), v, 8).select("layer", "i", "j", F.round("v", 2).alias("v"))


def pair_map(spark, d):
    m = B.matrices(spark, d)
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.5), (1, 1, 1.0)], "a int, b int, w double")
    return correlate.pair_map(m.select("layer", "a", "b", "i", "j", F.col("re").alias("v")), m.select("layer", "a", "b", "i", "j", F.col("im").alias("v")), w, w, 8, -0.25).select("i", "j", F.round("v", 3).alias("v"))


def bare_response(spark, d):
    e = B.bands(spark, d).withColumns({"u_re": F.array(F.lit(1.0)), "u_im": F.array(F.lit(0.0))})
    return correlate.bare_response(e, 8, 4.5, 0.3, 0.05, 0.1).select("i", "j", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


def bare_response_step(spark, d):
    e = B.bands(spark, d).withColumns({"u_re": F.array(F.lit(0.6), F.lit(0.8)), "u_im": F.array(F.lit(0.0), F.lit(0.5))})
    from ..operators import hopping

    return correlate.bare_response(hopping.orbitals(e, [1]), 8, 4.5, 0.0, 0.05).select("i", "j", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


def stored_response(spark, d):
    """A response map saved with its metadata and read back with it; an earlier, larger save of the run does not show."""
    path = scratch.new_folder(spark, "store")
    e = B.bands(spark, d).withColumns({"u_re": F.array(F.lit(1.0)), "u_im": F.array(F.lit(0.0))})
    chi = correlate.bare_response(e, 8, 4.5, 0.3, 0.05, 0.1).withColumn("layer", F.lit(0))
    store.save(B.grid(spark, d, N).withColumns({"re": F.col("v"), "im": F.col("v")}).drop("v"), path, "chi", "susceptibility", N)
    store.save(chi, path, "chi", "susceptibility", 8, [0.1], eta=0.05, extra={"omega_limit": "0.1", "resolution": "0.05"})
    meta = store.runs(spark, path).where("run_id = 'chi'").select("run_id", "module_type", "eta", "nq", F.col("extra")["omega_limit"].alias("omega_limit"), "cells")
    return store.load(spark, path, "chi").join(F.broadcast(meta), "run_id").select("run_id", "module_type", "eta", "nq", "omega_limit", "cells", "layer", "i", "j", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))  # one row


def stored_bands(spark, d):
    """A band surface, a layer for each band, with its provenance."""
    path = scratch.new_folder(spark, "store")
    surface = B.bands(spark, d).select(F.col("band").alias("layer"), "i", "j", "energy")
    store.save(surface, path, "bands", "ek2d", 8, bands=[0, 1, 2], extra={"source": "customer"})
    meta = store.runs(spark, path).where("run_id = 'bands'").select("run_id", "nq", F.size("bands").alias("bands"), F.array_join("layers", ",").alias("layers"), F.col("extra")["source"].alias("source"))
    return store.load(spark, path, "bands", layers=[1, 2]).join(F.broadcast(meta), "run_id").select("run_id", "nq", "bands", "layers", "source", "layer", "i", "j", F.round("energy", 9).alias("energy"))  # one row


def binned_response(spark, d):
    e = B.bands(spark, d).withColumns({"u_re": F.array(F.lit(1.0)), "u_im": F.array(F.lit(0.0))})
    return correlate.binned_response(e, 8, 4.5, 0.3, 0.05, 0.1, width=0.25).select("i", "j", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


def four_step_fourier(spark, d):
    """A mesh whose axes go in four steps."""
    g = B.grid(spark, d, STEPPED).select("layer", "i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return transform.dft(g, STEPPED).select("layer", "i", "j", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


QUERIES = {
    "a11_binned_response": binned_response, "g10_four_step_dft": four_step_fourier,
    "k02_stored_response": stored_response, "k03_stored_bands": stored_bands,
    "a06_autocorrelation_map": autocorrelation_map, "a06_joint_density": joint_density, "j04_correlation_by_dft": correlation_by_dft, "g01_g07_complete_mesh": complete_mesh,
    "g02_energy_axes": energy_axes, "g03_extended": extended, "g04_cropped": cropped, "g05_recentred": recentred, "g09_rolled_back": recentred_back, "g06_normalised": normalised,
    "g08_flipped": flipped, "g10_dft": fourier, "g10_fft_layers": fourier_layers, "p01_placed": placed, "g11_target_mesh": target_mesh, "k01_s20_stored_layers": stored_layers,
    "a08_scattering_map": scattering, "a10_pair_map": pair_map, "a11_bare_response": bare_response, "a11_p23_bare_response_step": bare_response_step,
}

_DFT = f"{FULL} SELECT layer, CAST(p AS INTEGER) AS i, CAST(q AS INTEGER) AS j, round(sum(v * cos(2 * pi() * ((i * p + j * q) % {N}) / {N})), 3) + 0.0 AS re, round(-sum(v * sin(2 * pi() * ((i * p + j * q) % {N}) / {N})), 3) + 0.0 AS im FROM f, range({N}) AS a(p), range({N}) AS b(q) GROUP BY ALL"


def _response(f: str, weight: str, omega: str) -> str:
    gap = f"({omega} + a.energy - b.energy)"
    return f"""WITH {B.BANDS_SQL}, o AS (SELECT *, {f} AS f FROM e)
SELECT CAST((((b.i - a.i) % 8) + 8) % 8 AS INTEGER) AS i, CAST((((b.j - a.j) % 8) + 8) % 8 AS INTEGER) AS j,
  round(-sum((a.f - b.f) * {weight} * {gap} / ({gap} * {gap} + 0.05 * 0.05)) / 64, 5) AS re, round(sum((a.f - b.f) * {weight} / ({gap} * {gap} + 0.05 * 0.05)) * 0.05 / 64, 5) AS im
FROM o a, o b WHERE a.f <> b.f GROUP BY ALL"""


SQL = {
    "a06_autocorrelation_map": f"WITH {B.grid_sql(N)}, {B.full_sql(N)}, {_CORR} SELECT layer, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v AS raw, CASE WHEN top > 0 THEN v / top ELSE v END AS norm FROM r WHERE i >= 4 AND i < 12 AND j >= 4 AND j < 12",
    "a06_joint_density": f"{WITH}, {B.full_sql(N)}, {_CORR} SELECT layer, CAST(i + s * {N} AS INTEGER) AS i, CAST(j + t * {N} AS INTEGER) AS j, round(v / top, 9) AS v, ((i + s * {N}) / {N} - 0.5) * 1.0 + ((j + t * {N}) / {N} - 0.5) * -0.5 AS x, ((i + s * {N}) / {N} - 0.5) * 0.0 + ((j + t * {N}) / {N} - 0.5) * 0.75 AS y FROM r, range(-1, 2) AS a(s), range(-1, 2) AS b(t) WHERE i + s * {N} >= -4 AND i + s * {N} < 20 AND j + t * {N} >= -4 AND j + t * {N} < 20",
    "j04_correlation_by_dft": f"WITH {B.grid_sql(N)}, {B.full_sql(N)}, {_CORR} SELECT layer, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 2) AS v FROM c",
    "g01_g07_complete_mesh": f"WITH {B.grid_sql(FINE)}, {B.full_sql(FINE)} SELECT m.layer, m.i, m.j, v, m.i / {FINE} - 0.5 AS u, m.j / {FINE} - 0.5 AS w FROM m LEFT JOIN g ON m.layer = g.layer AND m.i = g.i AND m.j = g.j",
    "g02_energy_axes": "SELECT p_partkey, CAST(m AS INTEGER) AS m, CASE WHEN round(p_size / 2.0) > 0 THEN m * CAST(p_size AS DOUBLE) / round(p_size / 2.0) - p_size ELSE -CAST(p_size AS DOUBLE) END AS energy, CASE WHEN round(p_size / 2.0) > 0 THEN m * CAST(p_size AS DOUBLE) / round(p_size / 2.0) - p_size ELSE -CAST(p_size AS DOUBLE) END + p_size AS shifted FROM part, unnest(range(0, CAST(round(p_size / 2.0) AS BIGINT) + 1)) AS u(m)",
    "g03_extended": f"{WITH} SELECT layer, CAST(i + s * {N} AS INTEGER) AS i, CAST(j + t * {N} AS INTEGER) AS j, v FROM g, range(-1, 2) AS a(s), range(-1, 2) AS b(t) WHERE i + s * {N} >= -8 AND i + s * {N} < 20 AND j + t * {N} >= -8 AND j + t * {N} < 20",
    "g04_cropped": f"{WITH} SELECT * FROM g WHERE i / {N} - 0.5 >= -0.3 AND i / {N} - 0.5 < 0.3 AND j / {N} - 0.5 >= -0.3 AND j / {N} - 0.5 < 0.3",
    "g05_recentred": f"{WITH} SELECT layer, CAST((i + 8) % {N} AS INTEGER) AS i, CAST((j + 8) % {N} AS INTEGER) AS j, v FROM g",
    "g09_rolled_back": f"{WITH} SELECT layer, CAST((i + 3 + 8) % {N} AS INTEGER) AS i, CAST((j - 5 + 8 + {N}) % {N} AS INTEGER) AS j, v FROM g",
    "g06_normalised": f"{WITH} SELECT layer, i, j, v, v / max(v) OVER (PARTITION BY layer) AS norm FROM g",
    "g08_flipped": f"{WITH} SELECT CASE WHEN layer % 2 = 0 THEN 'bwd' ELSE 'fwd' END AS direction, layer, 15 - i AS row, CASE WHEN layer % 2 = 0 THEN 15 - j ELSE j END AS col, v FROM g",
    "g10_dft": _DFT,
    "g10_fft_layers": _DFT,
    "p01_placed": f"{WITH} SELECT layer, i, j, v, (i / {N} - 0.5) * 1.5 + (j / {N} - 0.5) * -0.5 AS x, (i / {N} - 0.5) * 0.25 + (j / {N} - 0.5) * 2.0 AS y FROM g",
    "g11_target_mesh": "SELECT CAST(a AS INTEGER) AS ik, CAST(b AS INTEGER) AS ie, round(k0 + a * (k1 - k0) / 15, 6) AS gk, round(e0 + b * (e1 - e0) / 11, 6) AS ge FROM (SELECT CAST(min(user_id) AS DOUBLE) AS k0, CAST(max(user_id) AS DOUBLE) AS k1, min(value) AS e0, max(value) AS e1 FROM events), range(16) AS x(a), range(12) AS y(b)",
    "k01_s20_stored_layers": f"{WITH} SELECT 't' AS run_id, layer, CAST(i + s * {N} AS INTEGER) AS i, CAST(j + t * {N} AS INTEGER) AS j, v FROM g, range(0, 2) AS a(s), range(0, 2) AS b(t) WHERE layer IN (2, 5) AND i + s * {N} < 24 AND j + t * {N} < 24",
    "a08_scattering_map": f"""WITH {B.MATRICES_SQL}, v(a, b, vre, vim) AS (VALUES (0, 0, 1.0, 0.0), (0, 1, 0.0, 2.0), (1, 0, 0.0, -2.0), (1, 1, 3.0, 0.0)),
gv AS (SELECT layer, i, j, c.a, v.b AS c, sum(re * vre - im * vim) AS re, sum(re * vim + im * vre) AS im FROM c JOIN v ON c.b = v.a GROUP BY ALL)
SELECT x.layer, CAST((((y.i - x.i) % 8) + 8) % 8 AS INTEGER) AS i, CAST((((y.j - x.j) % 8) + 8) % 8 AS INTEGER) AS j, round(CAST(sum(x.re * y.im + x.im * y.re) AS DOUBLE) * (-1 / pi()), 2) AS v
FROM gv x JOIN c y ON x.layer = y.layer AND x.c = y.a AND x.a = y.b GROUP BY ALL""",
    "a10_pair_map": f"""WITH {B.MATRICES_SQL}, w(a, b, w) AS (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.5), (1, 1, 1.0)), m AS (SELECT c.*, w FROM c JOIN w USING (a, b))
SELECT CAST((((y.i - x.i) % 8) + 8) % 8 AS INTEGER) AS i, CAST((((y.j - x.j) % 8) + 8) % 8 AS INTEGER) AS j, round(CAST(sum(x.re * CAST(x.w AS DOUBLE) * y.im * CAST(y.w AS DOUBLE)) AS DOUBLE) * -0.25, 3) AS v
FROM m x JOIN m y ON x.layer = y.layer AND x.a = y.b AND x.b = y.a GROUP BY ALL""",
    "a11_bare_response": _response("CASE WHEN (energy - 4.5) / 0.3 > 0 THEN exp(-(energy - 4.5) / 0.3) / (1 + exp(-(energy - 4.5) / 0.3)) ELSE 1 / (1 + exp((energy - 4.5) / 0.3)) END", "1.0", "0.1"),
    "a11_p23_bare_response_step": _response("CASE WHEN energy < 4.5 THEN 1.0 ELSE 0.0 END", "((0.8 * 0.8 + 0.5 * 0.5) * (0.8 * 0.8 + 0.5 * 0.5))", "0.0"),
}
SQL["k02_stored_response"] = f"""WITH q AS ({SQL['a11_bare_response']})
SELECT 'chi' AS run_id, 'susceptibility' AS module_type, CAST(0.05 AS DOUBLE) AS eta, 8 AS nq, '0.1' AS omega_limit, (SELECT count(*) FROM q) AS cells, 0 AS layer, i, j, re, im FROM q"""
SQL["k03_stored_bands"] = f"""WITH {B.BANDS_SQL}
SELECT 'bands' AS run_id, 8 AS nq, 3 AS bands, '0,1,2' AS layers, 'customer' AS source, band AS layer, i, j, round(energy, 9) AS energy FROM e WHERE band IN (1, 2)"""
SQL["a11_binned_response"] = SQL["a11_bare_response"].replace("WITH e AS (", "WITH e0 AS (", 1).replace(", o AS (", ", e AS (SELECT i, j, band, (floor(energy / 0.25) + 0.5) * 0.25 AS energy FROM e0), o AS (", 1)
SQL["g10_four_step_dft"] = f"""WITH {B.grid_sql(STEPPED)}, x AS (SELECT layer, i, CAST(q AS INTEGER) AS q, sum(v * cos(2 * pi() * ((j * q) % {STEPPED}) / {STEPPED})) AS re, -sum(v * sin(2 * pi() * ((j * q) % {STEPPED}) / {STEPPED})) AS im FROM g, range({STEPPED}) AS b(q) GROUP BY ALL)
SELECT layer, CAST(p AS INTEGER) AS i, q AS j, round(sum(re * cos(2 * pi() * ((i * p) % {STEPPED}) / {STEPPED}) + im * sin(2 * pi() * ((i * p) % {STEPPED}) / {STEPPED})), 3) + 0.0 AS re,
  round(sum(im * cos(2 * pi() * ((i * p) % {STEPPED}) / {STEPPED}) - re * sin(2 * pi() * ((i * p) % {STEPPED}) / {STEPPED})), 3) + 0.0 AS im FROM x, range({STEPPED}) AS a(p) GROUP BY ALL"""
