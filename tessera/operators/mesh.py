"""Periodic meshes: generation, completion, recentring, extension, cropping, normalising.

A cell (i, j) of an n x n mesh has the coordinate i / n - 0.5; windows are turned into bounds on the integers before they
filter, since only those reach a Parquet scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mesh(spark: SparkSession, n: int) -> DataFrame:
    """All cells (i, j)."""
    return spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("i"), F.expr(f"cast(id % {n} as int)").alias("j"))


def coordinate(i: Column, n: int) -> Column:
    return i / F.lit(n) - 0.5


def energy_axes(limits: DataFrame, limit: str, step: float) -> DataFrame:
    """limits with (m, energy, shifted): per row an axis from -|limit| to 0 in about `step`, and its twin shifted by |limit|."""
    top = F.abs(F.col(limit))
    points = F.round(top / step).cast("int")
    each = limits.withColumn("m", F.explode(F.sequence(F.lit(0), points)))
    e = F.when(points > 0, F.col("m") * top / points - top).otherwise(-top)
    return each.withColumn("energy", e).withColumn("shifted", F.col("energy") + top)


def _keys(layer: str | list[str]) -> list[str]:
    return [layer] if isinstance(layer, str) else list(layer)


def complete(grid: DataFrame, n: int, layer: str | list[str] = "layer", value: str = "v", fill: float | None = 0.0) -> DataFrame:
    """Every cell of every layer (one column or several); cells without a value get `fill` (None: stay null)."""
    keys = _keys(layer)
    layers = grid.select(*keys).distinct()
    axis = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = layers.withColumn("i", axis).repartition(*keys, "i").withColumn("j", axis)  # tasks make a mesh row each
    out = cells.join(grid.select(*keys, "i", "j", value), [*keys, "i", "j"], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def recentred(grid: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """Cell 0 moves to the middle, or back."""
    by = -(n // 2) if inverse else n // 2
    return grid.withColumns({c: F.pmod(F.col(c) + by, F.lit(n)).cast("int") for c in ("i", "j")})


def rolled(grid: DataFrame, n: int, di: int, dj: int) -> DataFrame:
    """Periodic shift of all cells."""
    return grid.withColumns({"i": F.pmod(F.col("i") + di, F.lit(n)).cast("int"), "j": F.pmod(F.col("j") + dj, F.lit(n)).cast("int")})


def normalised(grid: DataFrame, layer: str | list[str] = "layer", value: str = "v", out: str = "norm") -> DataFrame:
    """The value over its layer's largest, where that is positive. The maxima are grouped (combined before their shuffle) and joined."""
    top = grid.groupBy(*_keys(layer)).agg(F.max(value).alias("_top"))
    return grid.join(top, _keys(layer)).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def index_bounds(low: float, high: float, n: int) -> tuple[int, int]:
    """Cells with low <= i / n - 0.5 < high, as first and one past the last number (also outside 0..n - 1)."""
    return math.ceil(round((low + 0.5) * n, 9)), math.ceil(round((high + 0.5) * n, 9))


def cropped(grid: DataFrame, n: int, low: float, high: float, strict: bool = False) -> DataFrame:
    """The cells inside the half-open window on both axes. strict: an empty result is an error."""
    first, end = index_bounds(low, high, n)
    if strict and (end <= first or end <= 0 or first >= n):
        raise ValueError(f"no cell of {n} lies in [{low}, {high})")
    return grid.where((F.col("i") >= first) & (F.col("i") < end) & (F.col("j") >= first) & (F.col("j") < end))


def extended(grid: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """The periodic continuation over [low, high) on both axes: whole copies shifted by integers, cropped half-open.

    i and j become numbers on the extended mesh (negative ones too); their coordinates are as before. The shifts are a short array in the plan."""
    first, end = index_bounds(low, high, n)
    shifts = F.array(*[F.lit(s * n) for s in range(math.floor(low + 0.5), math.ceil(high - 0.5) + 1)])
    out = grid
    for c in ("i", "j"):
        out = out.withColumn(f"_{c}", F.explode(shifts)).withColumn(c, (F.col(c) + F.col(f"_{c}")).cast("int")).where((F.col(c) >= first) & (F.col(c) < end)).drop(f"_{c}")
    return out


def placed(grid: DataFrame, n: int, basis: DataFrame | None) -> DataFrame:
    """Cells with Cartesian x, y for a 2-D basis (b00, b01, b10, b11); null without one. Several rows need a system_id on both sides, else they are an error."""
    u, v = coordinate(F.col("i"), n), coordinate(F.col("j"), n)
    if basis is None:
        return grid.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    names = ("b00", "b01", "b10", "b11")
    of = [c for c in ("system_id",) if c in basis.columns and c in grid.columns]
    single = F.when(F.count(F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error("several bases for one grid").cast("boolean"))
    one = basis.groupBy(*of).agg(*[F.max(c).alias(c) for c in names], F.count(F.lit(1)).alias("_n"), single.alias("_ok")).where("_n = 0 or _ok").drop("_n", "_ok")
    met = grid.join(one, of, "left") if of else grid.join(F.broadcast(one), how="left")  # one row
    return met.withColumns({"x": u * F.col("b00") + v * F.col("b10"), "y": u * F.col("b01") + v * F.col("b11")}).drop(*names)


def flipped(pixels: DataFrame, rows: int | Column, cols: int | Column, direction: str = "direction", scan_up: bool | Column = True) -> DataFrame:
    """Backward lines read right to left; upward scans start at the last row. Sizes and scan direction may be columns of pixels."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    col = F.when(F.col(direction) == "bwd", as_column(cols) - 1 - F.col("col")).otherwise(F.col("col"))
    row = F.when(as_column(scan_up), as_column(rows) - 1 - F.col("row")).otherwise(F.col("row"))
    return pixels.withColumns({"col": col, "row": row})


def flipped_scans(pixels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pixels of many files (file, direction, row, col, ...), each turned by its own size and scan direction. metadata: (file, nx, ny, direction); without one for a file it is left out."""
    own = metadata.select("file", F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), (F.col("direction") == "up").alias("_up"))
    return flipped(pixels.join(own, "file"), F.col("_ny"), F.col("_nx"), scan_up=F.col("_up")).drop("_nx", "_ny", "_up")


def spanned(points: DataFrame, nk: int, ne: int, k: str = "k", e: str = "e") -> DataFrame:
    """A (k, e) target mesh between the smallest and largest values of the points."""
    ends = points.agg(F.min(k).alias("k0"), F.max(k).alias("k1"), F.min(e).alias("e0"), F.max(e).alias("e1"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = ends.withColumn("ik", axis(nk)).repartition("ik").withColumn("ie", axis(ne))
    return cells.select("ik", "ie", (F.col("k0") + F.col("ik") * (F.col("k1") - F.col("k0")) / max(1, nk - 1)).alias("gk"), (F.col("e0") + F.col("ie") * (F.col("e1") - F.col("e0")) / max(1, ne - 1)).alias("ge"))


def extents(rows: DataFrame, keys: list[str], value: str, distinct: str | None = None) -> DataFrame:
    """Per key: the smallest and largest value (low, high), the rows (n) and, if asked, the different values of another column (`distinct`)."""
    more = [F.count_distinct(distinct).alias("distinct")] if distinct else []
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), *more)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
