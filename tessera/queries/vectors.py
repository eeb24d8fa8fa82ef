"""Lattice and polygon queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import lattice as LA
from ..operators import polygon as PG
from . import bindings as B

NOTCHED = [(0, 0.0, 0.0), (1, 8.0, 0.0), (2, 8.0, 8.0), (3, 4.0, 3.0), (4, 0.0, 8.0)]  # number, x, y
HEX = [(0.2 * math.cos(math.pi * k / 3), 0.2 * math.sin(math.pi * k / 3)) for k in range(6)]


def _rounded(df, digits=8, keep=("system_id", "axis", "ord", "m", "n", "item")):
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def dual_basis(spark, d):
    return _rounded(LA.long(LA.dual(B.lattices(spark, d)), "b"))


def supercell(spark, d):
    return _rounded(LA.transformed(LA.long(B.lattices(spark, d), "a"), LA.matrix(spark, [[2, 1], [-1, 1]])))


def subcell(spark, d):
    return _rounded(LA.transformed(LA.long(B.lattices(spark, d), "a"), LA.matrix(spark, [[2, 1], [-1, 1]], inverse=True)))


def rotated(spark, d):
    return _rounded(LA.rotated(LA.long(B.lattices(spark, d), "a"), F.lit(30.0)))


def lattice_checks(spark, d):
    out = LA.checks(B.lattices(spark, d))
    return out.select("system_id", *[F.round(c, 8).alias(c) for c in ("a1", "a2", "a3", "volume", "dual_volume")], (F.col("duality_error") < 1e-9).alias("dual_ok"), (F.col("round_trip_error") < 1e-9).alias("round_trip_ok"))


def cartesian(spark, d):
    frac = B.table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 10 + 1).alias("system_id"), *[((F.col("c_custkey") % p) / p).alias(f"f{k}") for k, p in ((1, 8), (2, 16), (3, 4))])
    return _rounded(LA.to_cartesian(frac, LA.long(B.lattices(spark, d), "a")))


def fractional(spark, d):
    cart = B.table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 10 + 1).alias("system_id"), *[((F.col("c_custkey") % p) / p).alias(c) for c, p in (("x", 8), ("y", 16), ("z", 4))])
    return _rounded(LA.to_fractional(cart, LA.long(B.lattices(spark, d), "a")), 11)


def _plane(spark, d):
    return B.lattices(spark, d).select("system_id", F.col("a1x").alias("b1x"), F.col("a1y").alias("b1y"), F.col("a2x").alias("b2x"), F.col("a2y").alias("b2y"))


def _hexagonal(spark, d):
    s = 1.0 + F.col("s_suppkey") % 5
    wide = F.when(F.col("s_suppkey") % 2 == 0, 0.5).otherwise(-0.5)
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("system_id"), s.alias("b1x"), F.lit(0.0).alias("b1y"), (s * wide).alias("b2x"), (s * math.sqrt(0.75)).alias("b2y"))


def orbit(spark, d):
    return LA.orbit(_hexagonal(spark, d)).select("system_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def zone_corners(spark, d):
    return LA.zone_vertices(_hexagonal(spark, d)).select("system_id", (F.round("vx", 6) + 0.0).alias("vx"), (F.round("vy", 6) + 0.0).alias("vy"))


def bragg_circle(spark, d):
    return _rounded(LA.bragg_in_circle(_plane(spark, d), 6.0), 6)


def bragg_folded(spark, d):
    rows = _plane(spark, d).withColumns({"s1x": F.col("b1x") / 2, "s1y": F.col("b1y") / 2, "s2x": F.col("b2x") / 3, "s2y": F.col("b2y") / 3})
    out = LA.bragg_folded(rows, 3)
    return out.groupBy("system_id", (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 5) + 0.0).alias("v")).agg(F.min(F.abs("m") + F.abs("n")).alias("size"))


def folded_cosets(spark, d):
    rows = _plane(spark, d).withColumns({"s1x": F.col("b1x") / 2, "s1y": F.col("b1y") / 2, "s2x": F.col("b2x") / 3, "s2y": F.col("b2y") / 3})
    out = LA.folded_cosets(rows)
    return out.select("system_id", (F.round("u", 5) + 0.0).alias("u"), (F.round("v", 5) + 0.0).alias("v"), (F.abs("m") + F.abs("n")).cast("int").alias("size"))


def polygon_mask(spark, d):
    pts = B.table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return LA.polygon_mask(pts, HEX).select("vec_id", "inside")


def polygon_table(spark, d):
    """A notched polygon for each supplier, of five corners or (even keys) four, against a place for each customer; many places lie on edges and corners."""
    p, s, c = B.table(spark, d, "supplier"), F.col("s_suppkey"), F.col("c_custkey")
    shape = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, x, y in NOTCHED]), lambda v: (s % 2 == 1) | (v["k"] != 3))
    corners = p.select(s, F.posexplode(shape).alias("n", "v")).select(
        s.alias("polygon_id"), (F.col("n") + 1).alias("ord"), ((s * 613) % 1024 / 8 + (1 + s % 7) * F.col("v.dx")).alias("x"), ((s * 389) % 1024 / 8 + (1 + s % 7) * F.col("v.dy")).alias("y")
    )
    places = B.table(spark, d, "customer").select(c, ((c * 7919) % 1361 / 8).alias("x"), ((c * 104729) % 1367 / 8).alias("y"))
    return PG.in_polygons(places, corners).select("c_custkey", "polygon_id")


QUERIES = {
    "g16_polygon_table": polygon_table,
    "p18_dual_basis": dual_basis, "p19_supercell": supercell, "p19_subcell": subcell, "p20_rotated": rotated, "p21_lattice_checks": lattice_checks, "p02_cartesian": cartesian, "p02_fractional": fractional,
    "g12_o02_orbit": orbit, "g15_zone_corners": zone_corners, "g14_o01_bragg_circle": bragg_circle, "g13_w07_bragg_folded": bragg_folded, "g13_folded_cosets": folded_cosets, "g16_polygon_mask": polygon_mask,
}

_L = f"WITH {B.LATTICES_SQL}"
_PLANAR = "v AS (SELECT system_id, 1 AS axis, a1x AS x, a1y AS y, 0.0::DOUBLE AS z FROM l UNION ALL SELECT system_id, 2, a2x, a2y, 0.0 FROM l UNION ALL SELECT system_id, 3, 0.0, 0.0, a3z FROM l)"


def _moved(m: str) -> str:
    return f"{_L}, {_PLANAR}, m(axis, t, m) AS (VALUES {m}) SELECT system_id, t AS axis, round(sum(CAST(m AS DOUBLE) * x), 8) + 0.0 AS x, round(sum(CAST(m AS DOUBLE) * y), 8) + 0.0 AS y, round(sum(CAST(m AS DOUBLE) * z), 8) + 0.0 AS z FROM v JOIN m USING (axis) GROUP BY ALL"


_D = "(a1x * a2y - a1y * a2x)"
_HEX = "s AS (SELECT s_suppkey AS system_id, CAST(1 + s_suppkey % 5 AS DOUBLE) AS c FROM supplier)"
_EDGES = ", ".join(f"({x0!r}::DOUBLE, {y0!r}::DOUBLE, {x1!r}::DOUBLE, {y1!r}::DOUBLE)" for (x0, y0), (x1, y1) in zip(HEX, HEX[1:] + HEX[:1], strict=True))
SQL = {
    "p18_dual_basis": f"{_L} SELECT system_id, 1 AS axis, round(2 * pi() * a2y / {_D}, 8) + 0.0 AS x, round(-2 * pi() * a2x / {_D}, 8) + 0.0 AS y, 0.0::DOUBLE AS z FROM l UNION ALL SELECT system_id, 2, round(-2 * pi() * a1y / {_D}, 8) + 0.0, round(2 * pi() * a1x / {_D}, 8) + 0.0, 0.0 FROM l UNION ALL SELECT system_id, 3, 0.0, 0.0, round(2 * pi() / a3z, 8) FROM l",
    "p19_supercell": _moved("(1, 1, 2), (1, 2, 1), (2, 1, -1), (2, 2, 1), (3, 3, 1), (1, 3, 0), (2, 3, 0), (3, 1, 0), (3, 2, 0)"),
    "p19_subcell": _moved("(1, 1, 1.0::DOUBLE / 3), (1, 2, -1.0::DOUBLE / 3), (2, 1, 1.0::DOUBLE / 3), (2, 2, 2.0::DOUBLE / 3), (3, 3, 1), (1, 3, 0), (2, 3, 0), (3, 1, 0), (3, 2, 0)"),
    "p20_rotated": f"{_L}, {_PLANAR} SELECT system_id, axis, round(x * cos(radians(30)) - y * sin(radians(30)), 8) + 0.0 AS x, round(x * sin(radians(30)) + y * cos(radians(30)), 8) + 0.0 AS y, z + 0.0 AS z FROM v",
    "p21_lattice_checks": f"{_L} SELECT system_id, round(sqrt(a1x * a1x + a1y * a1y), 8) AS a1, round(sqrt(a2x * a2x + a2y * a2y), 8) AS a2, a3z AS a3, round(abs({_D} * a3z), 8) AS volume, round(8 * pi() * pi() * pi() / abs({_D} * a3z), 8) AS dual_volume, true AS dual_ok, true AS round_trip_ok FROM l",
    "p02_cartesian": f"{_L}, c AS (SELECT c_custkey AS item, c_custkey % 10 + 1 AS system_id, (c_custkey % 8) / 8 AS f1, (c_custkey % 16) / 16 AS f2, (c_custkey % 4) / 4 AS f3 FROM customer) SELECT system_id, item, round(f1 * a1x + f2 * a2x, 8) + 0.0 AS x, round(f1 * a1y + f2 * a2y, 8) + 0.0 AS y, round(f3 * a3z, 8) + 0.0 AS z FROM c JOIN l USING (system_id)",
    "p02_fractional": f"{_L}, c AS (SELECT c_custkey AS item, c_custkey % 10 + 1 AS system_id, (c_custkey % 8) / 8 AS x, (c_custkey % 16) / 16 AS y, (c_custkey % 4) / 4 AS z FROM customer) SELECT system_id, item, round((x * a2y - y * a2x) / {_D}, 11) + 0.0 AS f1, round((y * a1x - x * a1y) / {_D}, 11) + 0.0 AS f2, round(z / a3z, 11) + 0.0 AS f3 FROM c JOIN l USING (system_id)",
    "g12_o02_orbit": f"WITH {_HEX} SELECT system_id, round(c * cos(pi() * k / 3), 6) + 0.0 AS x, round(c * sin(pi() * k / 3), 6) + 0.0 AS y FROM s, range(6) AS u(k)",
    "g15_zone_corners": f"WITH {_HEX} SELECT system_id, round(c / sqrt(3) * cos(pi() * k / 3 + pi() / 6), 6) + 0.0 AS vx, round(c / sqrt(3) * sin(pi() * k / 3 + pi() / 6), 6) + 0.0 AS vy FROM s, range(6) AS u(k)",
    "g14_o01_bragg_circle": f"{_L}, p AS (SELECT system_id, CAST(m AS INTEGER) AS m, CAST(n AS INTEGER) AS n, m * a1x + n * a2x AS x, m * a1y + n * a2y AS y FROM l, range(-40, 41) AS a(m), range(-40, 41) AS b(n) WHERE m <> 0 OR n <> 0) SELECT system_id, m, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(sqrt(x * x + y * y), 6) AS norm FROM p WHERE sqrt(x * x + y * y) <= 6.0 + 1e-12",
    "g13_w07_bragg_folded": f"{_L}, p AS (SELECT system_id, m / 2 AS u, n / 3 AS v, abs(m) + abs(n) AS size FROM l, range(-3, 4) AS a(m), range(-3, 4) AS b(n)) SELECT system_id, round(u - floor(u + 0.5), 5) + 0.0 AS u, round(v - floor(v + 0.5), 5) + 0.0 AS v, CAST(min(size) AS INTEGER) AS size FROM p GROUP BY ALL",
    "g16_polygon_mask": f"""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), e(x0, y0, x1, y1) AS (VALUES {_EDGES})
SELECT vec_id, count(*) FILTER (WHERE (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1 AS inside FROM p, e GROUP BY vec_id""",
}
SQL["g16_polygon_table"] = f"""WITH p AS (SELECT c_custkey, c_custkey * 7919 % 1361 / 8 AS x, c_custkey * 104729 % 1367 / 8 AS y FROM customer), o(k, dx, dy) AS (VALUES {", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, x, y in NOTCHED)}),
v AS (SELECT s_suppkey AS id, k, s_suppkey * 613 % 1024 / 8 + (1 + s_suppkey % 7) * dx AS x, s_suppkey * 389 % 1024 / 8 + (1 + s_suppkey % 7) * dy AS y FROM supplier, o WHERE s_suppkey % 2 = 1 OR k <> 3),
e AS (SELECT id, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM v WINDOW w AS (PARTITION BY id ORDER BY k)),
b AS (SELECT id, min(x0) AS xl, max(x0) AS xh, min(y0) AS yl, max(y0) AS yh FROM e GROUP BY id),
n AS (SELECT c_custkey, x, y, id FROM p, b WHERE x >= xl AND x <= xh AND y >= yl AND y <= yh)
SELECT c_custkey, id AS polygon_id FROM n JOIN e USING (id) GROUP BY ALL
HAVING bool_or(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= 1e-9 AND (x - x0) * (x1 - x0) + (y - y0) * (y1 - y0) BETWEEN 0 AND (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
OR count(*) FILTER (WHERE (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0))) % 2 = 1"""
SQL["g13_folded_cosets"] = SQL["g13_w07_bragg_folded"]
