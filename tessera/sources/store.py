"""The result store: layers as computed (not extended) in Parquet, in versions that appear whole or not at all.

A save writes a version folder of its own, parted by run, version and layer, and then publishes it with one row of the manifest: what the
version holds, its bounds, and the run's metadata. Readers take the latest published version of a run, so a save that fails, or still
runs, is invisible, and a run saved again with fewer layers has those layers only. One sink serves maps (re, im or v by layer), band surfaces
(a layer for each band) and densities alike."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh

_RUN = (
    "run_id string, module_type string, eta double, normalize boolean, nq int, energies array<double>, bands array<int>, extra map<string,string>, "
    "version string, layers array<int>, cells long, i_low int, i_high int, j_low int, j_high int"
)


def save(grid: DataFrame, path: str, run_id: str, module_type: str, nq: int, energies: list[float] = (), eta: float | None = None, normalize: bool = False, bands: list[int] = (), extra: dict[str, str] | None = None) -> str:
    """grid: (layer, i, j, values ...). Saving a run again replaces it for readers that come later. Returns the version's name."""
    spark = grid.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = grid.withColumns({"run_id": F.lit(run_id), "version": F.lit(version)}).repartition("layer")
    rows.write.mode("append").option("compression", "gzip").partitionBy("run_id", "version", "layer").parquet(f"{path}/layers")
    _publish(spark, path, version, (run_id, module_type, eta, normalize, nq, [float(e) for e in energies], list(bands), dict(extra or {})))
    return version


def _publish(spark: SparkSession, path: str, version: str, meta: tuple) -> None:
    """The manifest row; what is stated of the version is read back from its files. A version without layers is published as well."""
    held = _layers(spark, path).where((F.col("run_id") == meta[0]) & (F.col("version") == version))
    layers = sorted(r[0] for r in held.select("layer").distinct().collect())  # folders, not rows
    cells = held.agg(F.count(F.lit(1)), F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    row = spark.createDataFrame([(*meta, version, layers, *cells)], _RUN)
    row.coalesce(1).withColumn("saved", F.current_timestamp()).write.mode("append").parquet(f"{path}/runs")


def _layers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/layers").withColumns({"run_id": F.col("run_id").cast("string"), "version": F.col("version").cast("string")})


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest published metadata of each run."""
    return mesh.best_by(spark.read.parquet(f"{path}/runs"), ["run_id"], [F.desc("version")])


def versions(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """All published versions of a run."""
    return spark.read.parquet(f"{path}/runs").where(F.col("run_id") == run_id)


def load(spark: SparkSession, path: str, run_id: str, layers: list[int] | None = None, window: tuple[float, float] | None = None, basis: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """The layers of a run's latest version, or of a named one (partition filters), extended over a window and placed if asked."""
    known = versions(spark, path, run_id)
    row = (known.where(F.col("version") == version) if version else known).orderBy(F.desc("version")).select("version", "nq").first()
    if row is None:
        raise ValueError(f"no such version of run {run_id}" if version else f"no run {run_id}")
    grid = spark.read.parquet(f"{path}/layers").where((F.col("run_id") == run_id) & (F.col("version") == row.version)).drop("version")
    if layers is not None:
        grid = grid.where(F.col("layer").isin(layers))
    if window:
        grid = mesh.extended(grid, row.nq, *window)
    return mesh.placed(grid, row.nq, basis) if basis is not None else grid


def prune(spark: SparkSession, path: str, run_id: str) -> list[str]:
    """Deletes the layers of all versions of a run that are older than its latest published one; their names. Saves that still run are newer and stay."""
    latest = versions(spark, path, run_id).agg(F.max("version")).first()[0]
    old = [] if latest is None else [r.version for r in _layers(spark, path).where((F.col("run_id") == run_id) & (F.col("version") < latest)).select("version").distinct().collect()]
    for name in old:
        for r in _layers(spark, path).where((F.col("run_id") == run_id) & (F.col("version") == name)).select(F.col("_metadata.file_path").alias("file")).distinct().collect():
            file = spark._jvm.org.apache.hadoop.fs.Path(r.file)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
    return old
