"""Volumetric grids: voxel(cube_id, i, j, k, value) and cube_meta(cube_id, n1, n2, n3, origin and axis vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("n1", "n2", "n3", "ox", "oy", "oz", "a1x", "a1y", "a1z", "a2x", "a2y", "a2z", "a3x", "a3y", "a3z")


def compatible(meta: DataFrame, pairs: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per pair (first, second) of cubes, whether their grids, origins and axes agree, and the names of what differs."""
    a = meta.select(F.col("cube_id").alias("first"), *[F.col(c).alias(f"x_{c}") for c in META])
    b = meta.select(F.col("cube_id").alias("second"), *[F.col(c).alias(f"y_{c}") for c in META])
    both = pairs.join(a, "first", "left").join(b, "second", "left")
    off = F.array_compact(F.array(*[F.when(~F.coalesce(F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) <= (0 if c[0] == "n" else tol), F.lit(False)), F.lit(c)) for c in META]))
    return both.select("first", "second", off.alias("differs")).withColumn("ok", F.size("differs") == 0)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b on the voxels that both have; the join is by shuffle on the three numbers, at any size."""
    return a.select("i", "j", "k", F.col("value").alias("_a")).join(b.select("i", "j", "k", F.col("value").alias("_b")), ["i", "j", "k"]).select("i", "j", "k", (F.col("_a") - F.col("_b")).alias("value"))


# --- dense cubes: blocks of side^3 values as one array, stored in buckets of the block number ----------------------

SIDE = 16


def blocks(voxels: DataFrame, keys: list[str] = (), side: int = SIDE) -> DataFrame:
    """(keys, block, values) of voxels (keys, i, j, k, value): a row holds side^3 values in order of i, j, k, null where the cube has none; values keep their type.

    The block's number has 21 bits for each axis, so it is the same in all cubes whatever their shape. A voxel that occurs twice, or with a null or negative number, is an error."""
    parts = [F.floor(F.col(c) / side).cast("long") for c in "ijk"]
    number = F.shiftleft(parts[0], 42).bitwiseOR(F.shiftleft(parts[1], 21)).bitwiseOR(parts[2])
    ok = F.coalesce(F.least(*[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) for c in "ijk"]) >= 0, F.lit(False))
    at = ((F.col("i") % side * side + F.col("j") % side) * side + F.col("k") % side).cast("int")
    entry = F.struct(at.alias("at"), F.col("value").alias("value"))
    each = voxels.select(*keys, F.when(ok, number).otherwise(F.raise_error("a voxel's number is null or negative").cast("long")).alias("block"), entry.alias("e"))
    held = each.groupBy(*keys, "block").agg(F.collect_list("e").alias("es"))  # at most side^3, checked below
    kind = voxels.schema["value"].dataType
    absent = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(side**3 - 1)), F.col("es.at")), lambda p: F.struct(p.alias("at"), F.lit(None).cast(kind).alias("value")))
    full = F.sort_array(F.concat("es", absent))
    checked = F.when(F.size("full") == side**3, F.col("full.value")).otherwise(F.raise_error("a voxel occurs twice").cast(f"array<{kind.simpleString()}>"))
    return held.withColumn("full", full).select(*keys, "block", checked.alias("values"))


def unblocked(rows: DataFrame, keys: list[str] = (), side: int = SIDE) -> DataFrame:
    """Back to a row for each voxel that has a value."""
    each = rows.select(*keys, "block", F.posexplode("values").alias("at", "value")).where("value is not null")
    mask = (1 << 21) - 1
    first = {"i": F.shiftright("block", 42), "j": F.shiftright("block", 21).bitwiseAND(F.lit(mask)), "k": F.col("block").bitwiseAND(F.lit(mask))}
    inner = {"i": F.floor(F.col("at") / side**2), "j": F.floor(F.col("at") / side) % side, "k": F.col("at") % side}
    return each.select(*keys, *[(first[c] * side + inner[c]).cast("int").alias(c) for c in "ijk"], "value")


def save_blocks(rows: DataFrame, table: str, path: str, buckets: int) -> None:
    """Blocks of one cube as a table, a file for each bucket of the block number, sorted in it. Cubes that are to meet need the same number of buckets."""
    rows.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(table)


def block_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(block, values): a - b on the blocks that both have, null where either lacks a voxel. Between tables of save_blocks() no row is shuffled."""
    met = a.select("block", F.col("values").alias("_a")).hint("merge").join(b.select("block", F.col("values").alias("_b")), "block")
    return met.select("block", F.zip_with("_a", "_b", lambda x, y: x - y).alias("values"))
