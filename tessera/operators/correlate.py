"""Periodic correlations over a mesh: sums over all cells k of a(k) b(k + q).

Two routes give the same map. `pairs` joins the layer with itself and groups by the difference of the cells: exact for whole
numbers, n**4 products, combined before the shuffle. `dft` transforms, multiplies and transforms back: n**3. PAIRS_UP_TO decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import complex_product, occupation
from . import mesh, transform

PAIRS_UP_TO = 32


def _systems(*tables: DataFrame) -> list[str]:
    """["system_id"] if the tables have that column: systems are never summed into each other. Some with it and some without are an error."""
    have = ["system_id" in t.columns for t in tables]
    if any(have) and not all(have):
        raise ValueError("system_id must be a column of all tables or of none")
    return ["system_id"] if have[0] else []


def _difference(n: int) -> list[Column]:
    return [F.pmod(F.col(f"b_{c}") - F.col(f"a_{c}"), F.lit(n)).cast("int").alias(c) for c in ("i", "j")]


def _sides(a: DataFrame, b: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All pairs of cells of a and b with equal keys, other columns prefixed: a's rows meet b's one mesh row at a time, so that a mesh is n pieces of work."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys]).withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = b.select(*keys, F.col("i").alias("_row"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    return left.join(right, [*keys, "_row"]).drop("_row")


def correlation(a: DataFrame, b: DataFrame, n: int, keys: tuple[str, ...] = ("layer",), value: str = "v", route: str | None = None) -> DataFrame:
    """(keys, i, j, v): sum over k of a(k) b(k + q), q = (i, j). Real values; missing cells count as 0."""
    route = route or ("pairs" if n <= PAIRS_UP_TO else "dft")
    k = list(keys)
    if route == "pairs":
        both = _sides(a.select(*k, "i", "j", F.col(value).alias("v")), b.select(*k, "i", "j", F.col(value).alias("v")), k, n)
        return both.groupBy(*k, *_difference(n)).agg(F.sum(F.col("a_v") * F.col("b_v")).alias("v"))
    zero = F.lit(0.0)
    fa, fb = (transform.dft(x.select(*k, "i", "j", F.col(value).cast("double").alias("re"), zero.alias("im")), n, keys) for x in (a, b))
    both = fa.join(fb.withColumnsRenamed({"re": "re2", "im": "im2"}), [*k, "i", "j"])
    re, im = complex_product((F.col("re"), -F.col("im")), (F.col("re2"), F.col("im2")))
    return transform.dft(both.select(*k, "i", "j", re.alias("re"), im.alias("im")), n, keys, inverse=True).select(*k, "i", "j", F.col("re").alias("v"))


def autocorrelation_map(grid: DataFrame, n: int, low: float, high: float, layer: str = "layer", value: str = "v", route: str | None = None) -> DataFrame:
    """Per layer (of each system_id if there is one): completed, correlated with itself, recentred, normalised to its maximum, cropped. (layer, i, j, raw, norm)."""
    keys = [*_systems(grid), layer]
    full = mesh.complete(grid, n, keys, value)
    corr = correlation(full, full, n, tuple(keys), value, route)
    norm = mesh.normalised(mesh.recentred(corr, n), keys, "v")
    return mesh.cropped(norm, n, low, high).select(*keys, "i", "j", F.col("v").alias("raw"), "norm")


def joint_density(spectral: DataFrame, n: int, window: tuple[float, float] | None = None, basis: DataFrame | None = None, route: str | None = None) -> DataFrame:
    """Joint density of states from A(k, E) = (layer, i, j, v), of each system_id if there is one: correlated, recentred, normalised, extended, placed."""
    keys = [*_systems(spectral), "layer"]
    q = mesh.normalised(mesh.recentred(correlation(spectral, spectral, n, tuple(keys), route=route), n), keys, "v", "v").select(*keys, "i", "j", "v")
    return mesh.placed(mesh.extended(q, n, *window) if window else q, n, basis)


def scattering_map(green: DataFrame, v: DataFrame, n: int, keys: tuple[str, ...] = ("layer",), route: str | None = None) -> DataFrame:
    """-1/pi Im sum over k of Tr[G(k) V G(k + q)], of each system_id if there is one. green: (keys, i, j, a, b, re, im); v: (a, b, vre, vim), or one for each system.

    G V is contracted before the shifted join, which then meets on both matrix numbers. By the dft route the products of transforms are summed over
    the matrix numbers before the one transform back."""
    route = route or ("pairs" if n <= PAIRS_UP_TO else "dft")
    k = list(dict.fromkeys([*_systems(green), *keys]))
    keys = tuple(k)
    re, im = complex_product((F.col("re"), F.col("im")), (F.col("vre"), F.col("vim")))
    own = [c for c in ("system_id",) if c in v.columns and c in k]
    right = v.select(*own, F.col("a").alias("b"), F.col("b").alias("c"), "vre", "vim")
    gv = green.join(right, [*own, "b"]).groupBy(*k, "i", "j", "a", "c").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    gq = green.select(*k, "i", "j", F.col("a").alias("c"), F.col("b").alias("a"), "re", "im")
    if route == "dft":
        pair = (*k, "a", "c")
        x = transform.dft(gv.withColumn("im", -F.col("im")), n, pair)  # of the conjugate: its conjugate is what correlation needs
        y = transform.dft(gq, n, pair).withColumnsRenamed({"re": "re2", "im": "im2"})
        re, im = complex_product((F.col("re"), -F.col("im")), (F.col("re2"), F.col("im2")))
        total = x.join(y, [*pair, "i", "j"]).groupBy(*k, "i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
        return transform.dft(total, n, keys, inverse=True).select(*k, "i", "j", (F.col("im") * F.lit(-1 / math.pi)).alias("v"))
    both = _sides(gv, gq, [*k, "a", "c"], n)
    imaginary = F.col("a_re") * F.col("b_im") + F.col("a_im") * F.col("b_re")
    return both.groupBy(*k, *_difference(n)).agg((F.sum(imaginary) * F.lit(-1 / math.pi)).alias("v"))


def pair_map(first: DataFrame, second: DataFrame, m_first: DataFrame, m_second: DataFrame, n: int, prefactor: float, route: str | None = None) -> DataFrame:
    """Energy-integrated pair map of each system_id (if there is one): prefactor times the sum over layers, k, a, b of (M A)(k) (M' B)(k + q), both (layer, i, j, a, b, v).

    first and second are the spectral matrices of the two energies of a layer; each is weighted by its (a, b, w) selection. By the dft route the products of
    transforms are summed over layers and matrix numbers before the one transform back."""
    route = route or ("pairs" if n <= PAIRS_UP_TO else "dft")
    of = _systems(first, second)
    weigh = lambda x, m: x.join(m, ["a", "b"]).select(*of, "layer", "a", "b", "i", "j", (F.col("v") * F.col("w")).alias("v"))
    right = weigh(second, m_second).select(*of, "layer", F.col("b").alias("a"), F.col("a").alias("b"), "i", "j", "v")
    if route == "dft":
        keys = (*of, "layer", "a", "b")
        x, y = (transform.dft(t.select(*keys, "i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im")), n, keys) for t in (weigh(first, m_first), right))
        re, im = complex_product((F.col("re"), -F.col("im")), (F.col("re2"), F.col("im2")))
        total = x.join(y.withColumnsRenamed({"re": "re2", "im": "im2"}), [*keys, "i", "j"]).groupBy(*of, "i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
        return transform.dft(total, n, tuple(of), inverse=True).select(*of, "i", "j", (F.col("re") * F.lit(prefactor)).alias("v"))
    both = _sides(weigh(first, m_first), right, [*of, "layer", "a", "b"], n)
    return both.groupBy(*of, *_difference(n)).agg((F.sum(F.col("a_v") * F.col("b_v")) * F.lit(prefactor)).alias("v"))


def bare_response(eigen: DataFrame, n: int, mu: float, kt: float, eta: float, omega: float = 0.0) -> DataFrame:
    """chi0(q): mean over k, summed over band pairs, of (f_m(k) - f_n(k + q)) |<u_m(k)|u_n(k + q)>|^2 / (omega + e_m - e_n + i eta), with a minus sign.

    eigen: (i, j, band, energy, u_re, u_im arrays over orbitals), of each system_id if there is one. Pairs of equal occupation add nothing and are dropped row by row."""
    of = _systems(eigen)
    f = eigen.withColumn("f", occupation(F.col("energy"), F.lit(mu), F.lit(kt)))
    both = _sides(f, f, of, n).where("a_f <> b_f")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    re = dot("a_u_re", "b_u_re") + dot("a_u_im", "b_u_im")
    im = dot("a_u_re", "b_u_im") - dot("a_u_im", "b_u_re")
    gap = F.lit(omega) + F.col("a_energy") - F.col("b_energy")
    weight = (F.col("a_f") - F.col("b_f")) * (re * re + im * im) / (gap * gap + eta * eta)
    cells = float(n * n)
    return both.groupBy(*of, *_difference(n)).agg((-F.sum(weight * gap) / cells).alias("re"), (F.sum(weight) * F.lit(eta) / cells).alias("im"))


def binned_response(eigen: DataFrame, n: int, mu: float, kt: float, eta: float, omega: float = 0.0, width: float = 0.05) -> DataFrame:
    """bare_response() with energies moved to the middles of bins: n**3 products for each bin and pair of orbitals, in place of n**4 for each pair of bands.

    |<u|v>|^2 is the sum over orbitals a, c of P_ac(u) P_ca(v) with P_ac(u) = u_a conj(u_c). P is summed by cell and bin and transformed over the mesh; at each
    frequency the energy factor of two bins, a discrete Hilbert kernel of their difference, meets the two spectra as a matrix, and one transform leads back. An energy moves by
    at most width / 2; the values tend to those of bare_response() as width falls.

    A cell's matrix row holds the bins that occur between the lowest and the highest energy of the system."""
    of = _systems(eigen)
    bins = eigen.withColumn("bin", F.floor(F.col("energy") / width).cast("int"))
    ends = bins.groupBy(*of).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    each = bins.select(*of, "i", "j", "bin", F.posexplode(F.arrays_zip("u_re", "u_im")).alias("a", "x"), F.arrays_zip("u_re", "u_im").alias("u"))
    each = each.select(*of, "i", "j", "bin", "a", "x", F.posexplode("u").alias("c", "y"))
    re = F.col("x.u_re") * F.col("y.u_re") + F.col("x.u_im") * F.col("y.u_im")
    im = F.col("x.u_im") * F.col("y.u_re") - F.col("x.u_re") * F.col("y.u_im")
    p = each.groupBy(*of, "bin", "a", "c", "i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    spectra = transform.dft(p, n, (*of, "bin", "a", "c"))
    name = F.col("system_id").cast("string") if of else F.lit("")
    held = spectra.withColumn("system_id", name).groupBy("system_id", "a", "c", "i", "j").agg(F.sort_array(F.collect_list(F.struct("bin", "re", "im"))).alias("s"))  # a row a bin
    rows = held.join(ends.withColumn("system_id", name), "system_id")

    def meet(batches):
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, 2))
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            for k, s in enumerate(batch.column("s").to_pylist()):
                key = (int(low[k]), int(high[k]))
                if key not in tables:
                    e = (np.arange(key[0], key[1] + 1) + 0.5) * width
                    f = (e < mu).astype(float) if kt <= 0 else 1 / (1 + np.exp(np.clip((e - mu) / kt, -700, 700)))
                    tables = {key: (f[:, None] - f[None]) / (omega + e[:, None] - e[None] + 1j * eta)}
                g = np.zeros(key[1] - key[0] + 1, complex)
                at = [x["bin"] - key[0] for x in s]
                g[at] = [complex(x["re"], x["im"]) for x in s]
                total = np.conj(g) @ (tables[key] @ g)  # of P_ac(k) conjugated, which is P_ca, with P_ac(k + q)
                out[k] = total.real, total.imag
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("system_id", "i", "j")), pa.array(out[:, 0]), pa.array(out[:, 1])], ["system_id", "i", "j", "re", "im"])

    met = rows.select("system_id", "i", "j", "s", "low", "high").mapInArrow(meet, "system_id string, i int, j int, re double, im double")
    back = transform.dft(met.groupBy("system_id", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), n, ("system_id",), inverse=True)
    cells = float(n * n)
    return back.select(*of, "i", "j", (-F.col("re") / cells).alias("re"), (-F.col("im") / cells).alias("im"))
