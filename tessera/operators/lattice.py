"""Lattices as tables: (system_id, axis 1..3, x, y, z), one row for each vector.

Projections work on one row for each system, with the nine numbers side by side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import wrapped

_XYZ = ("x", "y", "z")


def wide(vectors: DataFrame, prefix: str = "a") -> DataFrame:
    """system_id, a1x .. a3z."""
    pick = [F.max(F.when(F.col("axis") == k, F.col(c))).alias(f"{prefix}{k}{c}") for k in (1, 2, 3) for c in _XYZ]
    return vectors.groupBy("system_id").agg(*pick)


def long(rows: DataFrame, prefix: str) -> DataFrame:
    """Back to a row for each vector."""
    vecs = F.array(*[F.struct(F.lit(k).alias("axis"), *[F.col(f"{prefix}{k}{c}").alias(c) for c in _XYZ]) for k in (1, 2, 3)])
    return rows.select("system_id", F.explode(vecs).alias("v")).select("system_id", "v.*")


def _v(p: str, k: int) -> list[Column]:
    return [F.col(f"{p}{k}{c}") for c in _XYZ]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def volume(prefix: str = "a") -> Column:
    return _dot(_v(prefix, 1), _cross(_v(prefix, 2), _v(prefix, 3)))


def dual(rows: DataFrame, prefix: str = "a", out: str = "b") -> DataFrame:
    """The dual basis times 2 pi: out_i . prefix_j = 2 pi delta_ij. A singular basis is an error. Works both ways."""
    v = F.when(F.abs(volume(prefix)) > 1e-12, volume(prefix)).otherwise(F.raise_error("singular basis").cast("double"))
    new = {}
    for k, (p, q) in {1: (2, 3), 2: (3, 1), 3: (1, 2)}.items():
        for c, value in zip(_XYZ, _cross(_v(prefix, p), _v(prefix, q)), strict=True):
            new[f"{out}{k}{c}"] = F.lit(2 * math.pi) * value / F.col("_v")
    return rows.withColumn("_v", v).withColumns(new).drop("_v")


def transformed(vectors: DataFrame, transform: DataFrame) -> DataFrame:
    """A' = M^T A: new axis `to` is the sum over `axis` of m * vector. transform: (axis, to, m)."""
    each = vectors.join(transform, "axis")
    return each.groupBy("system_id", F.col("to").alias("axis")).agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in _XYZ])


def matrix(spark: SparkSession, m: list[list[float]], inverse: bool = False) -> DataFrame:
    """A 2 x 2 or 3 x 3 transformation as a table (axis, to, m); 2 x 2 leaves the third axis. inverse: M^-1 (a subcell)."""
    if len(m) == 2:
        m = [[*m[0], 0], [*m[1], 0], [0, 0, 1]]
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) < 1e-12:
        raise ValueError("singular transformation")
    if inverse:
        m = [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]
    return spark.createDataFrame([(r + 1, c + 1, float(m[r][c])) for r in range(3) for c in range(3)], "axis int, to int, m double")


def rotated(vectors: DataFrame, degrees: Column) -> DataFrame:
    """All vectors turned about z."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return vectors.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def to_cartesian(fractional: DataFrame, vectors: DataFrame) -> DataFrame:
    """(system_id, item, f1, f2, f3) to x, y, z."""
    return fractional.join(wide(vectors), "system_id").select("system_id", "item", *[(F.col("f1") * F.col(f"a1{c}") + F.col("f2") * F.col(f"a2{c}") + F.col("f3") * F.col(f"a3{c}")).alias(c) for c in _XYZ])


def to_fractional(cartesian: DataFrame, vectors: DataFrame) -> DataFrame:
    """(system_id, item, x, y, z) to f1, f2, f3, through the dual basis."""
    rows = dual(wide(vectors))
    return cartesian.join(rows, "system_id").select("system_id", "item", *[(_dot([F.col("x"), F.col("y"), F.col("z")], _v("b", k)) / (2 * math.pi)).alias(f"f{k}") for k in (1, 2, 3)])


def checks(rows: DataFrame) -> DataFrame:
    """Per system: lengths, volumes of both cells, the largest deviation from duality, and that of going to the dual and back."""
    both = dual(dual(rows), "b", "c")
    off = [F.abs(_dot(_v("a", i), _v("b", j)) - (2 * math.pi if i == j else 0.0)) for i in (1, 2, 3) for j in (1, 2, 3)]
    back = [F.abs(F.col(f"a{k}{c}") - F.col(f"c{k}{c}")) for k in (1, 2, 3) for c in _XYZ]
    return both.select("system_id", *[F.sqrt(_dot(_v("a", k), _v("a", k))).alias(f"a{k}") for k in (1, 2, 3)], F.abs(volume("a")).alias("volume"), F.abs(volume("b")).alias("dual_volume"), F.greatest(*off).alias("duality_error"), F.greatest(*back).alias("round_trip_error"))


def from_plane(rows: DataFrame) -> DataFrame:
    """(system_id, axis, x, y, z) of a plane basis (b1x, b1y, b2x, b2y); the third vector is the unit vector along z."""
    vecs = F.array(*[F.struct(F.lit(k).alias("axis"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(z).alias("z")) for k, x, y, z in ((1, F.col("b1x"), F.col("b1y"), 0.0), (2, F.col("b2x"), F.col("b2y"), 0.0), (3, F.lit(0.0), F.lit(0.0), 1.0))])
    return rows.select("system_id", F.explode(vecs).alias("v")).select("system_id", "v.*")


# --- plane reciprocal vectors: (system_id, b1x, b1y, b2x, b2y) ----------------------------------------------------


def distinct_within(points: Column, tol: float) -> Column:
    """An array of (n, x, y) without the points that are within tol (on both axes) of an earlier one: equality by distance, so no bin's border divides equal points."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tol) & (F.abs(p["y"] - q["y"]) <= tol)
    return F.filter(points, lambda p: ~F.exists(points, lambda q: (q["n"] < p["n"]) & near(p, q)))


def orbit(rows: DataFrame, tol: float = 1e-6, negatives: bool = True) -> DataFrame:
    """The threefold orbit of b1, b2 (and of -b1, -b2) without repeats: (system_id, ord, x, y), clockwise. Its at most twelve vectors are compared within their row."""
    seeds = [(1, 1), (2, 1), (1, -1), (2, -1)][: 4 if negatives else 2]
    turned = []
    for n, (k, sign) in enumerate(seeds):
        for t in range(3):
            c, s = math.cos(2 * math.pi * t / 3), math.sin(2 * math.pi * t / 3)
            x, y = F.col(f"b{k}x") * sign, F.col(f"b{k}y") * sign
            turned.append(F.struct(F.lit(3 * n + t).alias("n"), (x * c - y * s).alias("x"), (x * s + y * c).alias("y")))
    each = rows.select("system_id", F.array(*turned).alias("all")).select("system_id", F.explode(distinct_within(F.col("all"), tol)).alias("v"))
    return clockwise(each.select("system_id", "v.x", "v.y"))


def clockwise(vectors: DataFrame, about_centre: bool = False) -> DataFrame:
    """(system_id, x, y) with ord 1, 2, ...: by falling angle, about the origin or the centroid."""
    w = Window.partitionBy("system_id")
    cx, cy = (F.avg("x").over(w), F.avg("y").over(w)) if about_centre else (F.lit(0.0), F.lit(0.0))
    v = vectors.withColumn("_angle", F.atan2(F.col("y") - cy, F.col("x") - cx))
    return v.withColumn("ord", F.row_number().over(w.orderBy(F.desc(F.round("_angle", 9)), "x"))).drop("_angle")


def zone_vertices(rows: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Corners of the first zone: intersections of neighbouring bisectors of the six shortest orbit vectors. Fewer than six are an error."""
    w = Window.partitionBy("system_id")
    star = orbit(rows, tol).drop("ord").withColumn("_n", F.row_number().over(w.orderBy(F.round(F.hypot("x", "y"), 9), F.atan2("y", "x")))).where("_n <= 6").drop("_n")
    ring = clockwise(star).withColumn("_size", F.count(F.lit(1)).over(w))
    o = w.orderBy("ord")
    nx, ny = F.coalesce(F.lead("x").over(o), F.first("x").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), F.coalesce(F.lead("y").over(o), F.first("y").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ring = ring.withColumns({"nx": nx, "ny": ny})
    h, hn = (F.col("x") ** 2 + F.col("y") ** 2) / 2, (F.col("nx") ** 2 + F.col("ny") ** 2) / 2
    det = F.col("x") * F.col("ny") - F.col("y") * F.col("nx")
    det = F.when(F.col("_size") == 6, det).otherwise(F.raise_error("the orbit has no six vectors").cast("double"))
    return ring.withColumn("_d", det).select("system_id", "ord", ((h * F.col("ny") - hn * F.col("y")) / F.col("_d")).alias("vx"), ((hn * F.col("x") - h * F.col("nx")) / F.col("_d")).alias("vy"))


def bragg_in_circle(rows: DataFrame, q_max: float, origin: bool = False, ordered: bool = False) -> DataFrame:
    """(system_id, m, n, x, y, norm): points m b1 + n b2 within q_max, by norm if ordered. The range of m and n follows from the cell's heights."""
    area = F.abs(F.col("b1x") * F.col("b2y") - F.col("b1y") * F.col("b2x"))
    top = lambda k: F.ceil(F.lit(q_max) * F.hypot(f"b{k}x", f"b{k}y") / area).cast("int")
    pts = rows.withColumn("m", F.explode(F.sequence(-top(2), top(2)))).withColumn("n", F.explode(F.sequence(-top(1), top(1))))
    pts = pts.withColumns({"x": F.col("m") * F.col("b1x") + F.col("n") * F.col("b2x"), "y": F.col("m") * F.col("b1y") + F.col("n") * F.col("b2y")}).withColumn("norm", F.hypot("x", "y"))
    out = pts.where(F.col("norm") <= q_max + 1e-12).where(F.lit(origin) | (F.col("m") != 0) | (F.col("n") != 0)).select("system_id", "m", "n", "x", "y", "norm")
    return out.orderBy("system_id", F.round("norm", 9), "m", "n") if ordered else out


def bragg_folded(rows: DataFrame, reach: int, digits: int = 6, ordered: bool = False) -> DataFrame:
    """Points m s1 + n s2 of a supercell's reciprocal lattice folded into the cell of b1, b2: (system_id, u, v, m, n), one for each folded
    point, that of the smallest |m| + |n|; by u and v if ordered. rows: b1x.. and s1x.., s2y."""
    det = F.col("b1x") * F.col("b2y") - F.col("b1y") * F.col("b2x")
    pts = rows.withColumn("m", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("n", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    gx, gy = F.col("m") * F.col("s1x") + F.col("n") * F.col("s2x"), F.col("m") * F.col("s1y") + F.col("n") * F.col("s2y")
    # g = u b1 + v b2
    u, v = (gx * F.col("b2y") - gy * F.col("b2x")) / det, (gy * F.col("b1x") - gx * F.col("b1y")) / det
    fold = lambda c: wrapped(F.round(c, digits))
    pts = pts.select("system_id", F.round(fold(u), digits).alias("u"), F.round(fold(v), digits).alias("v"), "m", "n")
    best = pts.groupBy("system_id", "u", "v").agg(F.min(F.struct((F.abs("m") + F.abs("n")).alias("size"), "m", "n")).alias("b"))
    out = best.select("system_id", "u", "v", "b.m", "b.n")
    return out.orderBy("system_id", "u", "v") if ordered else out


def _nearest(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def reduced_basis(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """A shortest basis (ax, ay, bx, by) of an integer lattice of rank two, by Lagrange's steps: the shorter vector is taken from the longer as often as it fits.

    The longer one shrinks by a third at least until none fits, so 64 steps are more than 64-bit numbers need."""
    start = F.struct(*[c.cast("long").alias(n) for c, n in ((ax, "ax"), (ay, "ay"), (bx, "bx"), (by, "by"))])

    def step(s, _):
        swap = s["ax"] * s["ax"] + s["ay"] * s["ay"] > s["bx"] * s["bx"] + s["by"] * s["by"]
        ax, ay = F.when(swap, s["bx"]).otherwise(s["ax"]), F.when(swap, s["by"]).otherwise(s["ay"])
        bx, by = F.when(swap, s["ax"]).otherwise(s["bx"]), F.when(swap, s["ay"]).otherwise(s["by"])
        times = _nearest((ax * bx + ay * by) / (ax * ax + ay * ay))
        return F.struct(ax.alias("ax"), ay.alias("ay"), (bx - times * ax).alias("bx"), (by - times * ay).alias("by"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)


def folded_cosets(rows: DataFrame, digits: int = 6) -> DataFrame:
    """bragg_folded() without a search range: (system_id, u, v, m, n), exactly |det| points for the integer matrix (m11, m12; m21, m22) with b1 = m11 s1 + m12 s2, b2 = m21 s1 + m22 s2.

    rows: system_id and the vectors b1x.. and s1x..; a matrix that is not of whole numbers (within 1e-6), or without a determinant, is an error. Points that differ by a vector of the
    lattice L of the matrix's rows fold into one. The Hermite normal form of L has the diagonal (g, |det| / g), g the common divisor of m11 and m21, so the cosets are 0 <= m < g, 0 <= n < |det| / g.
    The smallest |m| + |n| of a coset is found from a shortest basis (r, t) of L: its vector has at most two steps of t beside the nearest, because it is no longer than t, and on each of these lines the sum of absolute values is
    convex, so it is least next to a place where m or n changes sign. Ties go to the smallest m, then n."""
    det_s = F.col("s1x") * F.col("s2y") - F.col("s1y") * F.col("s2x")
    part = lambda k: ((F.col(f"b{k}x") * F.col("s2y") - F.col(f"b{k}y") * F.col("s2x")) / det_s, (F.col(f"b{k}y") * F.col("s1x") - F.col(f"b{k}x") * F.col("s1y")) / det_s)
    real = dict(zip(("m11", "m12", "m21", "m22"), (*part(1), *part(2)), strict=True))
    whole = F.greatest(*[F.abs(x - F.round(x)) for x in real.values()]) <= 1e-6
    out = rows.withColumns({n: F.when(whole, _nearest(x)).otherwise(F.raise_error("the cells have no whole-number matrix").cast("long")) for n, x in real.items()})
    det = F.col("m11") * F.col("m22") - F.col("m12") * F.col("m21")
    out = out.select("system_id", "m11", "m12", "m21", "m22", F.when(det != 0, det).otherwise(F.raise_error("the cells' matrix has no determinant").cast("long")).alias("det"))
    # Euclid's steps on (m11, m21); 94 are enough for 64-bit numbers
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(94)), F.struct(F.abs("m11").alias("a"), F.abs("m21").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))),
    )
    out = out.withColumn("g", pair["a"]).withColumn("r", reduced_basis(F.col("m11"), F.col("m12"), F.col("m21"), F.col("m22")))
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cosets = out.withColumn("m0", axis(F.col("g"))).withColumn("n0", axis(F.expr("abs(det) div g")))
    rx, ry, tx, ty = (F.col(f"r.{c}") for c in ("ax", "ay", "bx", "by"))
    near = _nearest((F.col("m0") * ry - F.col("n0") * rx) / (tx * ry - ty * rx).cast("double"))  # the coefficient along t
    lines = cosets.withColumn("k", F.explode(F.array(*[near + d for d in range(-2, 3)])))
    lines = lines.select("system_id", "m11", "m12", "m21", "m22", "det", "m0", "n0", rx.alias("rx"), ry.alias("ry"), (F.col("m0") - F.col("k") * tx).alias("lm"), (F.col("n0") - F.col("k") * ty).alias("ln"))
    turns = lambda p, q: F.when(F.col(q) != 0, -F.col(p) / F.nullif(F.col(q), F.lit(0)))
    at = [f(turns(p, q)).cast("long") + d for p, q in (("lm", "rx"), ("ln", "ry")) for f, d in ((F.floor, 0), (F.floor, 1))]
    tried = lines.withColumn("t", F.explode(F.array_compact(F.array(*at))))
    tried = tried.select("system_id", "m11", "m12", "m21", "m22", "det", "m0", "n0", (F.col("lm") + F.col("t") * F.col("rx")).alias("m"), (F.col("ln") + F.col("t") * F.col("ry")).alias("n"))
    of = ["system_id", "m11", "m12", "m21", "m22", "det", "m0", "n0"]
    best = tried.groupBy(*of).agg(F.min(F.struct((F.abs("m") + F.abs("n")).alias("size"), "m", "n")).alias("b")).select(*of, "b.m", "b.n")
    size = F.abs("det")

    def fold(top: Column) -> Column:
        """top / det folded into [-0.5, 0.5), in whole numbers."""
        part = F.pmod(top * F.signum("det").cast("long"), size)
        return F.round(F.when(2 * part >= size, part - size).otherwise(part) / size, digits)

    return best.select("system_id", fold(F.col("m") * F.col("m22") - F.col("n") * F.col("m21")).alias("u"), fold(F.col("n") * F.col("m11") - F.col("m") * F.col("m12")).alias("v"), "m", "n")


def polygon_mask(points: DataFrame, corners: list[tuple[float, float]], eps: float = 1e-9, x: str = "x", y: str = "y") -> DataFrame:
    """points with `inside`: within a polygon (corners in order), its boundary included. Ray casting as an expression: one pass, no join."""
    px, py = F.col(x), F.col(y)
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        dx, dy = x1 - x0, y1 - y0
        length = math.hypot(dx, dy)
        if not length:  # a repeated corner
            on_edge = on_edge | (F.hypot(px - x0, py - y0) <= eps)
            continue
        across = (px - x0) * dy - (py - y0) * dx
        along = (px - x0) * dx + (py - y0) * dy
        on_edge = on_edge | ((F.abs(across) <= eps * length) & (along >= -eps * length) & (along <= length * length + eps * length))
        if dy:
            hit = ((F.lit(y0) > py) != (F.lit(y1) > py)) & (px < x0 + (py - y0) * (dx / dy))
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return points.withColumn("inside", on_edge | (crossings % 2 == 1))
