"""Discrete Fourier transforms over the two axes of a mesh, as grouped sums (the transform is separable).

On a short axis a pass multiplies each value by the n phases of its axis and sums by target: n times the rows, combined before their shuffle. From FACTORED_FROM on, an axis
of n = n1 * n2 cells is transformed in four steps: short sums over n1 cells, twiddle factors, an exchange, and short sums over n2 cells, so that the rows grow by n1 and by n2
(about the root of n) and a layer needs no task of its own. Layers with many cells that fit a worker may instead go through `fft_layers`, one Arrow group for each layer."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Axes of this length or more go in four steps, if their length has a factor.
FACTORED_FROM = 64


def _factor(n: int) -> int:
    """The largest divisor of n that is not above its root."""
    return max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)


def _summed(rows: DataFrame, angle, by: list) -> DataFrame:
    c, s = F.cos(angle), F.sin(angle)
    return rows.groupBy(*by).agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("re") * s + F.col("im") * c).alias("im"))


def _four_steps(grid: DataFrame, n: int, n1: int, axis: str, sign: int, keys: list[str]) -> DataFrame:
    """x = n2 x1 + x2 and q = q1 + n1 q2: the phase x q / n is x q1 / n, which holds the twiddle factor, plus x2 q2 / n2."""
    n2, other = n // n1, "j" if axis == "i" else "i"
    first = grid.withColumn("_q1", F.explode(F.sequence(F.lit(0), F.lit(n1 - 1))))
    angle = F.lit(sign * 2 * math.pi / n) * F.pmod(F.col(axis) * F.col("_q1"), F.lit(n))
    half = _summed(first, angle, [*keys, other, F.pmod(F.col(axis), F.lit(n2)).alias("_x2"), "_q1"])
    second = half.withColumn("_q2", F.explode(F.sequence(F.lit(0), F.lit(n2 - 1))))
    angle = F.lit(sign * 2 * math.pi / n2) * F.pmod(F.col("_x2") * F.col("_q2"), F.lit(n2))
    return _summed(second, angle, [*keys, other, (F.col("_q1") + n1 * F.col("_q2")).alias(axis)])


def _axis(grid: DataFrame, n: int, axis: str, sign: int, keys: list[str]) -> DataFrame:
    if n >= FACTORED_FROM and (n1 := _factor(n)) > 1:
        return _four_steps(grid, n, n1, axis, sign, keys)
    other = "j" if axis == "i" else "i"
    out = grid.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = F.lit(sign * 2 * math.pi / n) * F.pmod(F.col(axis) * F.col("_q"), F.lit(n))
    return _summed(out, angle, [*keys, other, "_q"]).withColumnRenamed("_q", axis)


def dft(grid: DataFrame, n: int, keys: tuple[str, ...] = ("layer",), inverse: bool = False) -> DataFrame:
    """(keys, i, j, re, im) to its transform; missing cells count as 0. The inverse divides by n * n."""
    sign = 1 if inverse else -1
    out = _axis(_axis(grid.select(*keys, "i", "j", "re", "im"), n, "j", sign, list(keys)), n, "i", sign, list(keys))
    scale = F.lit(1.0 / (n * n)) if inverse else F.lit(1.0)
    return out.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def fft_layers(grid: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The same for (layer int, i, j, re, im), with one Arrow group for each layer: for many layers of bounded size."""

    def run(t: pa.Table) -> pa.Table:
        a = np.zeros((n, n), complex)
        a[t["i"].to_numpy(), t["j"].to_numpy()] = t["re"].to_numpy() + 1j * t["im"].to_numpy()
        a = np.fft.ifft2(a) if inverse else np.fft.fft2(a)
        i, j = np.mgrid[0:n, 0:n].reshape(2, -1).astype(np.int32)
        return pa.table({"layer": pa.array(np.full(n * n, t["layer"][0].as_py(), np.int32)), "i": i, "j": j, "re": a.real.reshape(-1), "im": a.imag.reshape(-1)})

    return grid.select(F.col("layer").cast("int").alias("layer"), "i", "j", "re", "im").groupBy("layer").applyInArrow(run, "layer int, i int, j int, re double, im double")
