"""Kernel sums: spectral weights, broadened maps, thermal broadening.

Energies are a short axis in the plan; a mesh of targets is met one of its rows at a time by an equi-join. The products are combined into
their target before the shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.scalar import lorentzian, lorentzian_2d


def spectral_weight(eigen: DataFrame, energies: list[float], eta: float) -> DataFrame:
    """A(k, E): the Lorentzians of all bands of a cell, for each energy. eigen: (i, j, band, energy); out: (layer, layer_value, i, j, v), of each system_id if there is one."""
    of = [c for c in ("system_id",) if c in eigen.columns]
    axis = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(float(e)).alias("e")) for n, e in enumerate(energies)])
    each = eigen.withColumn("at", F.explode(axis)).select(*of, "i", "j", F.col("at.layer").alias("layer"), F.col("at.e").alias("layer_value"), "energy")
    return each.groupBy(*of, "layer", "layer_value", "i", "j").agg(F.sum(lorentzian(F.col("layer_value"), F.col("energy"), eta)).alias("v"))


def broadened_map(points: DataFrame, cells: DataFrame, wk: float, we: float, weight: str = "w") -> DataFrame:
    """A at each cell (ik, ie, gk, ge): the weighted 2-D kernels of all points (k0, e0, w).

    Equal points are summed first; then each meets the rows ik of the mesh one by one, whatever the mesh's size."""
    few = points.groupBy("k0", "e0").agg(F.sum(weight).alias("w"))
    kernel = lorentzian_2d(F.col("gk") - F.col("k0"), F.col("ge") - F.col("e0"), wk, we)
    low, high = cells.agg(F.min("ik"), F.max("ik")).first()
    each = few.withColumn("ik", F.explode(F.sequence(F.lit(low), F.lit(high)) if low is not None else F.array().cast("array<int>")))
    return each.join(cells, "ik").groupBy("ik", "ie", "gk", "ge").agg(F.sum(F.col("w") * kernel).alias("a"))


def near_tiles(side: float, tol: float) -> int:
    """How many tiles apart (on either axis) two tiles may be and still be summed exactly by tiled_map().

    Beyond that, a second-order expansion about both centres is off by at most 4 (2 r)^3 / (1 + R^2)^(5/2) of a tile's weight, with r the half diagonal of a tile and
    R the least distance of the two tiles (third derivatives of 1 / (1 + |x|^2) are at most 24 / (1 + |x|^2)^(5/2) along any line), while the kernel is at least 1 / (1 + (R + 4 r)^2) there."""
    r, d = side / math.sqrt(2), 1
    while 4 * (2 * r) ** 3 * (1 + (d * side + 4 * r) ** 2) / (1 + (d * side) ** 2) ** 2.5 > tol:
        d += 1
    return d


def tiled_map(points: DataFrame, cells: DataFrame, wk: float, we: float, weight: str = "w", tol: float = 1e-3, side: float = 1.0) -> DataFrame:
    """broadened_map() with far points met by tile: for weights of one sign each value is within tol (relative) of the exact sum.

    In units of the widths, points and cells are dealt to square tiles. Tiles at most near_tiles() apart are summed exactly, through an equi-join on coarser blocks. Farther
    tiles of points are six moments each; a tile of cells takes from each of them the six coefficients of a polynomial, whose sum its cells evaluate. What is shuffled are nine rows a point, the cells, and
    pairs of tiles, never points x cells; moments and coefficients are combined before their shuffle."""
    d = near_tiles(side, tol)
    tile = lambda c: F.floor(F.col(c) / F.lit(side))
    centre = lambda c: (F.col(c) + 0.5) * F.lit(side)
    few = points.groupBy("k0", "e0").agg(F.sum(weight).alias("w")).withColumns({"x": F.col("k0") / wk, "y": F.col("e0") / we}).withColumns({"ti": tile("x"), "tj": tile("y")})
    own = cells.withColumns({"x": F.col("gk") / wk, "y": F.col("ge") / we}).withColumns({"ui": tile("x"), "uj": tile("y")})
    # near: blocks of d tiles, each point in its own block and the eight around it
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = few.withColumn("o", around).select("w", "ti", "tj", F.col("x").alias("px"), F.col("y").alias("py"), (F.floor(F.col("ti") / d) + F.col("o.a")).alias("bi"), (F.floor(F.col("tj") / d) + F.col("o.b")).alias("bj"))
    met = own.select("ik", "ie", "x", "y", "ui", "uj", F.floor(F.col("ui") / d).alias("bi"), F.floor(F.col("uj") / d).alias("bj")).join(spread, ["bi", "bj"])
    met = met.where((F.abs(F.col("ti") - F.col("ui")) <= d) & (F.abs(F.col("tj") - F.col("uj")) <= d))
    dist = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    near = met.groupBy("ik", "ie").agg(F.sum(F.col("w") / (1 + dist)).alias("near"))
    # far: moments of the points about their tile's centre
    sx, sy = F.col("x") - centre("ti"), F.col("y") - centre("tj")
    moments = few.groupBy("ti", "tj").agg(F.sum("w").alias("m"), *[F.sum(F.col("w") * v).alias(n) for n, v in (("mx", sx), ("my", sy), ("mxx", sx * sx), ("mxy", sx * sy), ("myy", sy * sy))])
    tiles = own.select("ui", "uj").distinct()
    low, high = tiles.agg(F.min("ui"), F.max("ui")).first()
    each = moments.withColumn("ui", F.explode(F.sequence(F.lit(low), F.lit(high)) if low is not None else F.array().cast("array<bigint>"))).join(tiles, "ui")
    each = each.where((F.abs(F.col("ti") - F.col("ui")) > d) | (F.abs(F.col("tj") - F.col("uj")) > d))
    dx, dy = (F.col("ui") - F.col("ti")) * side, (F.col("uj") - F.col("tj")) * side
    each = each.withColumns({"dx": dx, "dy": dy}).withColumn("q", 1 / (1 + F.col("dx") ** 2 + F.col("dy") ** 2))
    gx, gy = (-2 * F.col(c) * F.col("q") ** 2 for c in ("dx", "dy"))
    hxx, hyy = (8 * F.col(c) ** 2 * F.col("q") ** 3 - 2 * F.col("q") ** 2 for c in ("dx", "dy"))
    hxy = 8 * F.col("dx") * F.col("dy") * F.col("q") ** 3
    m, mx, my, mxx, mxy, myy = (F.col(c) for c in ("m", "mx", "my", "mxx", "mxy", "myy"))
    parts = {
        "c": F.col("q") * m - gx * mx - gy * my + (hxx * mxx + hyy * myy) / 2 + hxy * mxy, "cx": gx * m - hxx * mx - hxy * my, "cy": gy * m - hxy * mx - hyy * my,
        "cxx": hxx * m / 2, "cxy": hxy * m, "cyy": hyy * m / 2,
    }
    sums = each.groupBy("ui", "uj").agg(*[F.sum(v).alias(n) for n, v in parts.items()])
    tx, ty = F.col("x") - centre("ui"), F.col("y") - centre("uj")
    far = F.col("c") + F.col("cx") * tx + F.col("cy") * ty + F.col("cxx") * tx * tx + F.col("cxy") * tx * ty + F.col("cyy") * ty * ty
    out = own.join(sums, ["ui", "uj"], "left").withColumn("far", far).join(near, ["ik", "ie"], "left")
    return out.where("near is not null or far is not null").select("ik", "ie", "gk", "ge", (F.coalesce("near", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))).alias("a"))


def thermal(spectra: DataFrame, kt: float, reach: int | None = None, key: str = "spectrum") -> DataFrame:
    """A spectrum (spectrum, p, e, v) broadened by -df/dE of the energy differences, zero outside, over the kernel's full sum.

    The kernel depends on the difference of two points of one spectrum; reach limits it to neighbours at most that many points away, which are met without a row for each pair in a shuffle."""
    x = (F.col("e0") - F.col("e")) / F.lit(2 * kt)
    bell = F.lit(1 / (4 * kt)) / (F.cosh(x) * F.cosh(x))
    if reach is None:
        both, of = spectra.select(key, F.col("p").alias("p0"), F.col("e").alias("e0")).join(spectra.select(key, "p", "e", "v"), key), [key]
    else:
        both, of = _neighbours(spectra, reach, key), [key, "_chunk"]
    sums = both.withColumn("g", bell).groupBy(*of, "p0", "e0").agg(F.sum(F.col("v") * F.col("g")).alias("s"))
    ends = spectra.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("low"), F.max("e").alias("high"))
    step = (F.col("high") - F.col("low")) / F.greatest(F.lit(1), F.col("n") - 1)
    far = reach if reach is not None else None
    offsets = F.sequence(-(F.col("n") - 1), F.col("n") - 1) if far is None else F.sequence(F.lit(-far), F.lit(far))
    y = lambda d: d * F.col("step") / F.lit(2 * kt)
    norm = ends.withColumn("step", step).withColumn("d", F.explode(offsets)).groupBy(key).agg(F.sum(F.lit(1 / (4 * kt)) / (F.cosh(y(F.col("d"))) * F.cosh(y(F.col("d"))))).alias("norm"))
    return sums.join(norm, key).select(key, F.col("p0").alias("p"), F.col("e0").alias("e"), (F.col("s") / F.col("norm")).alias("v"))


def _neighbours(spectra: DataFrame, reach: int, key: str, chunk: int = 1 << 12) -> DataFrame:
    """(key, _chunk, p0, e0, e, v): each point with those of its spectrum at most reach numbers away, missing ones left out.

    A point is shuffled once, and again for each other chunk of `chunk` numbers whose halo holds it; its neighbours come from a window of numbers in its own chunk."""
    size = max(chunk, 4 * reach)
    at = lambda c: F.floor(c / F.lit(size))
    p = F.col("p")
    spread = spectra.where(p.isNotNull()).select(key, "p", "e", "v", F.explode(F.sequence(at(p - reach), at(p + reach))).alias("_chunk"))
    near = F.collect_list(F.struct("e", "v")).over(Window.partitionBy(key, "_chunk").orderBy("p").rangeBetween(-reach, reach))  # of one chunk and its halo
    own = spread.withColumn("_near", near).where(at(p) == F.col("_chunk"))
    return own.select(key, "_chunk", p.alias("p0"), F.col("e").alias("e0"), F.explode("_near").alias("_n")).select(key, "_chunk", "p0", "e0", "_n.e", "_n.v")


def thermal_reach(step: float, kt: float, tol: float) -> int:
    """Points beyond which the kernel's tails weigh at most tol of its sum, for a spectrum with this step.

    1 / cosh(x)^2 is below 4 exp(-2 x), so the tails beyond r points add up to at most 8 exp(-(r + 1) s) / (1 - exp(-s)) with s = step / kt; the sum is at least 1."""
    s = step / kt
    return max(0, math.ceil(math.log(8 / (tol * -math.expm1(-s))) / s) - 1)


def thermal_chunks(spectra: DataFrame, kt: float, tol: float = 1e-9, key: str = "spectrum", chunk: int = 1 << 14) -> DataFrame:
    """thermal() for long spectra (spectrum, p = 0, 1, ..., e, v), in one pass over chunks of points with a halo of the kernel's support (overlap-save).

    The kernel is cut where its tails weigh at most tol of its sum (thermal_reach, by each spectrum's mean step), so for even steps a value is off by at most tol times
    the spectrum's largest |v|, twice. A chunk is a group of chunk + 2 * reach points at most; each point is in its own chunk and in those whose halo holds it. Points with a null e or v add nothing."""
    spectra = spectra.withColumns({c: F.col(c).cast("double") for c in ("e", "v")})
    ends = spectra.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("e").alias("_low"), F.max("e").alias("_high"), F.min("p").alias("_first"), F.max("p").alias("_last"))
    step = (F.col("_high") - F.col("_low")) / F.greatest(F.lit(1), F.col("_n") - 1)
    s = step / F.lit(kt)
    reach = F.greatest(F.lit(0), F.ceil(F.log(F.lit(8.0) / (F.lit(tol) * -F.expm1(-s))) / s) - 1)
    ends = ends.select(key, step.alias("_step"), F.least(F.col("_n") - 1, F.when(s > 0, reach).otherwise(F.col("_n") - 1)).cast("long").alias("_reach"), F.floor(F.col("_first") / chunk).alias("_first"), F.floor(F.col("_last") / chunk).alias("_last"))
    p = F.col("p").cast("long")
    near = F.sequence(F.greatest("_first", F.floor((p - F.col("_reach")) / chunk)), F.least("_last", F.floor((p + F.col("_reach")) / chunk)))
    each = spectra.select(key, p.alias("p"), "e", "v").join(ends, key).withColumn("_chunk", F.explode(near))
    names = StructType([each.schema[key], StructField("p", LongType()), StructField("e", DoubleType()), StructField("v", DoubleType())])

    def broaden(t: pa.Table) -> pa.Table:
        t = t.sort_by("p")
        at, e, v = (t[c].to_numpy() for c in ("p", "e", "v"))
        c, reach, step = t["_chunk"][0].as_py(), t["_reach"][0].as_py(), t["_step"][0].as_py()
        own = np.flatnonzero((at >= c * chunk) & (at < (c + 1) * chunk))
        bell = lambda d: 1 / (4 * kt) / np.cosh(np.clip(d / (2 * kt), -300, 300)) ** 2
        total = np.zeros(len(own))
        gap = np.isnan(e) | np.isnan(v)
        offsets = np.arange(-reach, reach + 1)
        strip = max(1, (1 << 18) // len(offsets))
        for lo in range(0, len(own), strip):  # by difference of numbers: a missing point adds nothing
            rows = own[lo : lo + strip]
            asked = at[rows][:, None] + offsets
            there = np.minimum(np.searchsorted(at, asked), len(at) - 1)
            hit = (at[there] == asked) & ~gap[there]
            total[lo : lo + strip] = (np.where(hit, v[there], 0) * bell(np.where(hit, e[rows][:, None] - e[there], 0))).sum(1)
        norm = bell(np.arange(-reach, reach + 1) * step).sum()
        mine = t.take(pa.array(own))
        return pa.table({key: mine[key], "p": mine["p"], "e": mine["e"], "v": pa.array(total / norm)}).cast(names_arrow)

    names_arrow = to_arrow_schema(names)
    return each.groupBy(key, "_chunk").applyInArrow(broaden, names)
