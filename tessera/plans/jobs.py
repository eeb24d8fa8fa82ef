"""The lifecycles that users run: hopping files to a quasiparticle map, a calculation folder to a broadened spectral map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import BOLTZMANN_EV
from ..operators import broaden, correlate, hopping, mesh
from ..sources import calculation as C
from ..sources import lines as L
from ..sources import store
from . import scratch


def bands(table: DataFrame, size: int, nk: int) -> DataFrame:
    """Hopping table to eigenpairs on the mesh."""
    return hopping.eigen(hopping.packed(hopping.bloch_sum(table, nk), size), size)


def joint_density_map(spark: SparkSession, hopping_path: str, nk: int, energies: list[float], eta: float, window: tuple[float, float] | None = None, save_to: str | None = None, run_id: str = "jdos") -> DataFrame:
    """Hopping files to joint-density layers: stored as computed, then extended for the caller."""
    header, table, bad = C.hopping_tables(L.text_lines(spark, hopping_path))
    check = hopping.complete_check(table, header)
    if not bad.isEmpty() or not check.where("not ok").isEmpty():
        raise ValueError("incomplete hopping table")
    size, systems = header.agg(F.max("num_wann"), F.count_distinct("system_id")).first()
    if systems != 1:
        raise ValueError(f"a map is made of one system's table, not of {systems}")
    path = scratch.new_folder(spark, "eigen")
    bands(table, size, nk).write.parquet(path)  # read once for each energy's sum
    weight = broaden.spectral_weight(spark.read.parquet(path), energies, eta).select("layer", "i", "j", "v")  # one system
    q = correlate.joint_density(weight, nk)
    if save_to:
        store.save(q, save_to, run_id, "jdos", nk, energies, eta, True)
        return store.load(spark, save_to, run_id, window=window)
    return mesh.extended(q, nk, *window) if window else q


def spectral_map(spark: SparkSession, out_path: str, weights_path: str, length_nm: float, kelvin: float, nk: int, ne: int, element: str | None = None, atom: int | None = None) -> DataFrame:
    """A structure output and an unfolding-weight file to A(k, E) of the selected orbitals."""
    import math

    lines = L.text_lines(spark, out_path).withColumn("file", F.lit("run"))
    weights = L.text_lines(spark, weights_path).withColumn("file", F.lit("run"))
    atoms = C.positions(lines, C.unit_cells(lines))
    columns = C.orbital_columns(atoms, C.species(lines))
    points = C.selected_weight(C.unfolding(weights, columns), element, atom).select(F.col("kpath").alias("k0"), F.col("energy").alias("e0"), "w")
    if points.isEmpty():
        raise ValueError("no weight column matches the selection")
    cells = mesh.spanned(points, nk, ne, "k0", "e0")
    return broaden.broadened_map(points, cells, 2 * math.pi / (10 * length_nm), math.log(3 + 2 * math.sqrt(2)) * BOLTZMANN_EV * kelvin)
