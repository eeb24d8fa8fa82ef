"""Hopping tables H(R) to matrices, bands and resolvents over a mesh.

hopping: (system_id, r1, r2, r3, m, n, re, im, ndegen), m and n from 0. Sums over R are grouped sums with partial combination; dense linear algebra
runs on Arrow batches of packed matrices, one row for each matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import complex_product


def complete_check(body: DataFrame, header: DataFrame) -> DataFrame:
    """Per system: matrix and R counts against the header (num_wann, nrpts), rows with too few tokens, and `ok`."""
    seen = body.groupBy("system_id").agg(F.count_distinct("r1", "r2", "r3").alias("r_seen"), F.count(F.lit(1)).alias("rows_seen"), F.sum(F.when(F.col("re").isNull() | F.col("im").isNull(), 1).otherwise(0)).alias("bad_rows"))
    out = header.join(seen, "system_id", "left").fillna(0, ["r_seen", "rows_seen", "bad_rows"])
    return out.withColumn("ok", (F.col("r_seen") == F.col("nrpts")) & (F.col("rows_seen") == F.col("nrpts") * F.col("num_wann") * F.col("num_wann")) & (F.col("bad_rows") == 0))


def hermitian(hopping: DataFrame) -> DataFrame:
    """(H(R) + H(-R)^+) / 2: what a Hermitian H(k) needs. Missing partners count as 0."""
    keys = ["system_id", "r1", "r2", "r3", "m", "n"]
    own = hopping.select(*keys, (F.col("re") / 2).alias("re"), (F.col("im") / 2).alias("im"), "ndegen")
    back = hopping.select("system_id", *[(-F.col(c)).alias(c) for c in ("r1", "r2", "r3")], F.col("n").alias("m"), F.col("m").alias("n"), (F.col("re") / 2).alias("re"), (-F.col("im") / 2).alias("im"), "ndegen")
    return own.unionByName(back).groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.max("ndegen").alias("ndegen"))


def bloch_sum(hopping: DataFrame, nk: int, centred: bool = True) -> DataFrame:
    """H(k) on the nk x nk mesh of the first two axes: (system_id, i, j, m, n, re, im).

    The sum over R goes axis by axis: rows grow by nk a pass and are combined in between, not by nk * nk at once."""
    start = 0.5 if centred else 0.0
    w = hopping.select("system_id", "r1", "r2", "m", "n", (F.col("re") / F.col("ndegen")).alias("re"), (F.col("im") / F.col("ndegen")).alias("im"))
    for r, c, rest in (("r2", "j", ["r1"]), ("r1", "i", ["j"])):
        each = w.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(nk - 1))))
        angle = F.lit(2 * math.pi) * F.col(r) * (F.col(c) / F.lit(nk) - start)
        re, im = complex_product((F.col("re"), F.col("im")), (F.cos(angle), F.sin(angle)))
        w = each.groupBy("system_id", *rest, c, "m", "n").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return w.select("system_id", "i", "j", "m", "n", "re", "im")


#: Elements of the dense matrices that a task makes at once.
ELEMENTS = 1 << 20


def packed(matrices: DataFrame, size: int) -> DataFrame:
    """(system_id, i, j, re, im): each matrix as two row-major arrays; missing elements are 0, an element that comes twice is an error.

    A matrix's elements are gathered as they come and scattered to their places in an Arrow batch: size * size steps a matrix."""
    cells = F.collect_list(F.struct((F.col("m") * size + F.col("n")).cast("int").alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")))  # size * size elements
    rows = matrices.groupBy("system_id", "i", "j").agg(cells.alias("c")).select("system_id", "i", "j", "c.at", "c.re", "c.im")
    out = StructType([*rows.schema.fields[:3], *(StructField(c, ArrayType(DoubleType())) for c in ("re", "im"))])

    def scatter(batches):
        most = max(1, ELEMENTS // (size * size))
        for whole in batches:
            for lo in range(0, whole.num_rows, most):
                batch = whole.slice(lo, most)
                lists = batch.column("at")
                place = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()) * (size * size) + lists.flatten().to_numpy()
                if len(np.unique(place)) < len(place):
                    raise ValueError("an element of a matrix comes twice")
                dense = []
                for c in ("re", "im"):
                    full = np.zeros(batch.num_rows * size * size)
                    full[place] = batch.column(c).flatten().to_numpy()
                    dense.append(_lists(full, size * size))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *dense], out.names)

    return rows.mapInArrow(scatter, out)


def _stack(batch: pa.RecordBatch, size: int) -> np.ndarray:
    re, im = (batch.column(c).flatten().to_numpy().reshape(-1, size, size) for c in ("re", "im"))
    return re + 1j * im


def _lists(a: np.ndarray, width: int) -> pa.Array:
    flat = np.ascontiguousarray(a, float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def eigen(matrices: DataFrame, size: int) -> DataFrame:
    """Hermitian eigen-decomposition of packed matrices: (system_id, i, j, band, energy, u_re, u_im), energies ascending."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                e, u = np.linalg.eigh(_stack(batch, size))
                keys = [batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), size))) for c in ("system_id", "i", "j")]
                vec = u.transpose(0, 2, 1).reshape(-1, size)  # a row for each band
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(np.arange(size, dtype=np.int32), batch.num_rows)), pa.array(e.reshape(-1)), _lists(vec.real, size), _lists(vec.imag, size)], ["system_id", "i", "j", "band", "energy", "u_re", "u_im"])

    return matrices.select(F.col("system_id").cast("string"), F.col("i").cast("int"), F.col("j").cast("int"), "re", "im").mapInArrow(run, "system_id string, i int, j int, band int, energy double, u_re array<double>, u_im array<double>")


def resolvent(matrices: DataFrame, size: int, energies: list[float], eta: float) -> DataFrame:
    """G = (E + i eta - H)^-1 for each matrix and energy: (system_id, layer, i, j, a, b, re, im)."""
    axis = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(float(e)).alias("e")) for n, e in enumerate(energies)])

    def run(batches):
        a, b = (x.reshape(-1).astype(np.int32) for x in np.mgrid[0:size, 0:size])
        for batch in batches:
            if batch.num_rows:
                e = batch.column("e").to_numpy()
                g = np.linalg.inv((e + 1j * eta)[:, None, None] * np.eye(size) - _stack(batch, size)).reshape(-1)
                take = pa.array(np.repeat(np.arange(batch.num_rows), size * size))
                keys = [batch.column(c).take(take) for c in ("system_id", "layer", "i", "j")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(a, batch.num_rows)), pa.array(np.tile(b, batch.num_rows)), pa.array(g.real), pa.array(g.imag)], ["system_id", "layer", "i", "j", "a", "b", "re", "im"])

    rows = matrices.withColumn("at", F.explode(axis)).select(F.col("system_id").cast("string"), F.col("at.layer").alias("layer"), F.col("i").cast("int"), F.col("j").cast("int"), "re", "im", F.col("at.e").alias("e"))
    return rows.mapInArrow(run, "system_id string, layer int, i int, j int, a int, b int, re double, im double")


def spectral_matrix(green: DataFrame) -> DataFrame:
    """-Im G / pi."""
    return green.select("system_id", "layer", "i", "j", "a", "b", (F.col("im") * F.lit(-1 / math.pi)).alias("v"))


def orbitals(eigen_rows: DataFrame, select: list[int] | None) -> DataFrame:
    """Eigenvectors on chosen orbitals only (all by default)."""
    if select is None:
        return eigen_rows
    keep = lambda c: F.filter(c, lambda x, p: p.isin(select))
    return eigen_rows.withColumns({"u_re": keep("u_re"), "u_im": keep("u_im")})
