"""Polygons as a table: which polygons hold which points, by a cover of cells and ray casting on border cells only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import new_folder

_EDGE = ("x0", "y0", "x1", "y1")
_NEAR = 16  # edges of a row of cells that its border cells carry themselves; more of them stay rows of a table
_FEW = 2  # of a border cell's edges, tested without a function of lists
_CROWD = 4096  # points in a cell; those of fuller cells are dealt out over copies of it
_MEMBERS = 1024  # polygons of a class in one list, about


def edges(corners: DataFrame) -> DataFrame:
    """(polygon_id, x0, y0, x1, y1) of corners (polygon_id, ord, x, y); each corner meets the next by its number, so a polygon's corners may lie in many tasks.

    ord must be 1, 2, ... without gaps, and coordinates finite: anything else is an error. Corners without a polygon_id belong to no polygon."""
    known = corners.where("polygon_id is not null")
    sizes = known.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_lo"), F.max("ord").alias("_hi"), F.count_distinct("ord").alias("_d"))
    whole = (F.col("_lo") == 1) & (F.col("_hi") == F.col("_n")) & (F.col("_d") == F.col("_n"))
    sizes = sizes.select("polygon_id", F.when(whole, F.col("_n")).otherwise(F.raise_error("a polygon's corners are not numbered 1, 2, ...").cast("long")).alias("corners"))
    finite = lambda c: F.when(F.abs(c) < float("inf"), c).otherwise(F.raise_error("a corner is not finite").cast("double"))
    at = known.select("polygon_id", F.col("ord").cast("long").alias("ord"), finite(F.col("x").cast("double")).alias("x0"), finite(F.col("y").cast("double")).alias("y0")).join(sizes, "polygon_id")
    ends = at.select("polygon_id", (F.when(F.col("ord") == 1, F.col("corners")).otherwise(F.col("ord") - 1)).alias("ord"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return at.join(ends, ["polygon_id", "ord"]).select("polygon_id", "corners", *_EDGE)


def classes(sides: DataFrame) -> DataFrame:
    """(polygon_id, class_id): polygons with the same edges share the smallest one's id, as they hold the same places. Two hashes propose, the edges themselves decide."""
    each = sides.groupBy("polygon_id", *_EDGE).agg(F.count(F.lit(1)).alias("_c"))
    prints = each.groupBy("polygon_id").agg(F.sum("_c").alias("_n"), *[F.bit_xor(F.xxhash64(F.lit(k), *_EDGE, "_c")).alias(f"_h{k}") for k in (0, 1)])
    by = ["_n", "_h0", "_h1"]
    proposed = prints.join(prints.groupBy(*by).agg(F.min("polygon_id").alias("class_id")), by).select("polygon_id", "class_id", "_n")
    others = proposed.where("polygon_id <> class_id")
    same = each.join(others, "polygon_id").join(each.withColumnRenamed("polygon_id", "class_id"), ["class_id", *_EDGE, "_c"])
    sure = same.groupBy("polygon_id", "class_id", "_n").agg(F.sum("_c").alias("_m")).where("_m = _n").select("polygon_id", "class_id")
    return prints.select("polygon_id").join(sure, "polygon_id", "left").select("polygon_id", F.coalesce("class_id", "polygon_id").alias("class_id"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table that several later steps read."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _sized(sides: DataFrame, eps: float, fineness: int) -> DataFrame:
    """Edges with their polygon's cell `c`, a power of two `level`: 2^fineness + 2 sqrt(corners) cells or a little more along the longer side of its box, so that a row of
    cells meets some sqrt(corners) edges and the cover has some 4 corners + 4^(fineness + 1) cells at most. `pad`: what a border is widened by."""
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    box = sides.groupBy("polygon_id").agg(
        F.greatest(high("x0", "x1") - low("x0", "x1"), high("y0", "y1") - low("y0", "y1")).alias("_side"),
        F.max(F.greatest(*[F.abs(c) for c in _EDGE])).alias("_far"), F.first("corners").alias("_n"),
    )
    least = F.greatest(F.col("_side"), F.lit(64 * eps), F.col("_far") * 1e-6, F.lit(1e-290))
    level = F.floor(F.log2(least / (2.0**fineness + 2 * F.sqrt("_n")))).cast("int")
    box = box.withColumn("level", level).withColumn("c", F.pow(F.lit(2.0), F.col("level")))
    box = box.select("polygon_id", "level", "c", (2 * eps + F.col("c") * 1e-9 + F.col("_far") * 1e-12).alias("pad"))
    return sides.drop("corners").join(box, "polygon_id")


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / F.col("c")), F.floor(high / F.col("c"))))


def bands(sized: DataFrame) -> DataFrame:
    """Each edge with the rows of cells `iy` that it comes near."""
    return sized.withColumn("iy", _cells(F.least("y0", "y1") - F.col("pad"), F.greatest("y0", "y1") + F.col("pad")))


def cover(banded: DataFrame) -> DataFrame:
    """(polygon_id, level, ix, iy, border): cells near an edge, and cells that lie inside as a whole.

    Border: the part of an edge in a row of cells, widened by pad. Inside: between the first and second, third and fourth, ... edge on the row's middle line; no edge is near
    such a cell, so its middle stands for all of it. The crossings of one polygon and row are sorted in one task, as narrow rows."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cut = lambda y: F.when(dy == 0, None).otherwise(F.least(F.greatest((y - F.col("y0")) / F.nullif(dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    bottom, top = F.col("iy") * F.col("c") - F.col("pad"), (F.col("iy") + 1) * F.col("c") + F.col("pad")
    ends = [F.col("x0") + F.coalesce(cut(y), F.lit(float(k))) * dx for k, y in ((0, bottom), (1, top))]
    border = banded.select("polygon_id", "level", "iy", _cells(F.least(*ends) - F.col("pad"), F.greatest(*ends) + F.col("pad")).alias("ix"), F.lit(True).alias("border"))
    middle = (F.col("iy") + 0.5) * F.col("c")
    met = banded.where((F.col("y0") > middle) != (F.col("y1") > middle)).select("polygon_id", "level", "c", "iy", (F.col("x0") + (middle - F.col("y0")) * (dx / F.nullif(dy, F.lit(0.0)))).alias("at"))
    row = Window.partitionBy("polygon_id", "iy").orderBy("at")
    spans = met.select("polygon_id", "level", "c", "iy", "at", F.lead("at").over(row).alias("to"), F.row_number().over(row).alias("nth")).where("nth % 2 = 1")
    lo, hi = F.ceil(F.col("at") / F.col("c") - 0.5), F.floor(F.col("to") / F.col("c") - 0.5)
    inside = spans.where(lo <= hi).select("polygon_id", "level", "iy", F.explode(F.sequence(lo, hi)).alias("ix"), F.lit(False).alias("border"))
    return border.unionByName(inside).groupBy("polygon_id", "level", "ix", "iy").agg(F.max("border").alias("border"))


def _lists(members: DataFrame) -> DataFrame:
    """(class_id, ids): the polygons of each class in lists; a large class has several, so that none is held whole."""
    parts = members.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).alias("_parts"))
    dealt = members.join(parts, "class_id").withColumn("_part", F.pmod(F.xxhash64("polygon_id"), "_parts"))
    return dealt.groupBy("class_id", "_part").agg(F.sort_array(F.collect_list("polygon_id")).alias("ids")).select("class_id", "ids")


def _measured(banded: DataFrame) -> DataFrame:
    """Edges with what the test of a place needs."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return banded.select("polygon_id", "iy", "c", "pad", F.struct(*_EDGE, dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("length"), (dx / F.nullif(dy, F.lit(0.0))).alias("slope")).alias("edge"))


def _on_edge(e: Column, px: Column, py: Column, eps: float) -> Column:
    length = e["length"]
    across, along = (px - e["x0"]) * e["dy"] - (py - e["y0"]) * e["dx"], (px - e["x0"]) * e["dx"] + (py - e["y0"]) * e["dy"]
    return F.when(length == 0, F.hypot(px - e["x0"], py - e["y0"]) <= eps).otherwise((F.abs(across) <= eps * length) & (along >= -eps * length) & (along <= length * length + eps * length))


def _hit(e: Column, px: Column, py: Column) -> Column:
    return ((e["y0"] > py) != (e["y1"] > py)) & (px < e["x0"] + (py - e["y0"]) * e["slope"])


def _narrowed(cells: DataFrame) -> DataFrame:
    """Border cells with the edges `near` of their row: those on the left, which no ray to the right meets, are left out, and those on the right that cross the whole row, which all
    rays meet, are counted in `odd`."""
    low, high = (lambda k: F.col(k) * F.col("c") - F.col("pad")), (lambda k: (F.col(k) + 1) * F.col("c") + F.col("pad"))
    across = lambda e: (F.least(e["x0"], e["x1"]) > high("ix")) & (F.least(e["y0"], e["y1"]) <= low("iy")) & (F.greatest(e["y0"], e["y1"]) >= high("iy"))
    odd = F.size(F.filter("near", across)) % 2
    return cells.withColumns({"odd": odd, "near": F.filter("near", lambda e: (F.greatest(e["x0"], e["x1"]) >= low("ix")) & ~across(e))}).drop("c", "pad")


def _inside(px: Column, py: Column, eps: float) -> Column:
    """Of a place in a border cell with near and odd; the first edges of a list without a function of lists, which takes some ten times as long."""
    few = [F.get("near", F.lit(k)) for k in range(_FEW)]
    on = [F.coalesce(_on_edge(e, px, py, eps), F.lit(False)) for e in few]
    hits = [F.when(_hit(e, px, py), 1).otherwise(0) for e in few]
    quick = reduce(or_, on) | ((F.col("odd") + sum(hits[1:], hits[0])) % 2 == 1)
    rest = F.exists("near", lambda e: _on_edge(e, px, py, eps)) | ((F.col("odd") + F.size(F.filter("near", lambda e: _hit(e, px, py)))) % 2 == 1)
    return F.when(F.size("near") <= _FEW, quick).otherwise(rest)


def _on_grids(points: DataFrame, levels: list[int]) -> DataFrame:
    """Points (px, py, ...) with their cell of each level."""
    grids = [F.struct(F.lit(k).alias("level"), F.lit(2.0**k).alias("c")) for k in levels]
    each = points.withColumn("_l", F.explode(F.array(*grids) if grids else F.lit(None).cast("array<struct<level:int,c:double>>")))
    return each.select(*points.columns, F.col("_l.level").alias("level"), F.floor(F.col("px") / F.col("_l.c")).alias("ix"), F.floor(F.col("py") / F.col("_l.c")).alias("iy"))


def _held_by_rows(places: DataFrame, cells: DataFrame, edges_of_rows: DataFrame, levels: list[int], eps: float) -> DataFrame:
    """(px, py, polygon_id): different places in border cells whose row meets many edges, each tested against these edges as rows of a table."""
    px, py, edge = F.col("px"), F.col("py"), F.col("edge")
    met = _on_grids(places.distinct(), levels).join(cells, ["level", "ix", "iy"]).select("px", "py", "polygon_id", "iy").join(edges_of_rows, ["polygon_id", "iy"])
    judged = met.groupBy("polygon_id", "iy", "px", "py").agg(F.max(_on_edge(edge, px, py, eps)).alias("_on"), F.sum(F.when(_hit(edge, px, py), 1).otherwise(0)).alias("_hits"))
    return judged.where(F.col("_on") | (F.col("_hits") % 2 == 1)).select("px", "py", "polygon_id")


def in_polygons(points: DataFrame, corners: DataFrame, eps: float = 1e-9, fineness: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """The rows of points with `polygon_id`: one for each polygon that holds the row's place, its boundary (within eps) included, as lattice.polygon_mask says for one polygon.

    corners: (polygon_id, ord, x, y), ord 1, 2, ... along the polygon; a last corner that repeats the first does no harm, and places inside twice (a polygon that crosses itself) count as
    outside. Points with a null or NaN coordinate, or beyond all polygons, give no row; repeated points give a row each; a column of points named polygon_id is an error.

    Rows of points meet cells by an equi-join on (level, ix, iy). A cell carries its different polygon's members (see classes) and, on the border, the edges of its row of cells; so a row is
    tested where it meets the cell and gives its results there: what is shuffled grows with points and polygons, not with the results. Rows of a full cell are dealt out over copies of the cell.
    Only where a row of cells meets more than some edges, different places meet them by a second join, and rows meet the places. Results of a cell stand together, for each row the members of
    a polygon, which files compress well. Only the levels in use pass the driver, which are exponents of doubles: about 2,100 numbers at most, mostly a few."""
    if "polygon_id" in points.columns:
        raise ValueError("points have a column polygon_id already")
    sides = _kept(edges(corners), "edges")
    members = _kept(classes(sides), "classes")
    first = members.where("polygon_id = class_id").select("polygon_id")
    sized = _kept(_sized(sides.join(first, "polygon_id"), eps, fineness), "sized")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few edges and places make many cells and rows, and small inputs would be put together in one task
    levels = sorted(r.level for r in sized.select("level").distinct().collect())
    lists = _kept(_lists(members), "members")
    px, py, key = F.col("px"), F.col("py"), ["level", "ix", "iy"]
    spread = ["px", "py"] if any(t in kind for _, kind in points.dtypes for t in ("map<", "variant")) else ["_row"]  # such columns have no hash
    rows = points.select(F.struct("*").alias("_row"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where((F.abs(px) < float("inf")) & (F.abs(py) < float("inf"))).withColumn("_hash", F.xxhash64(*spread))
    banded = bands(sized.repartition(tasks, "polygon_id"))
    cells, measured = cover(banded), _measured(banded)
    crowded = _kept(banded.groupBy("polygon_id", "iy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _NEAR).select("polygon_id", "iy"), "crowded")
    full = _kept(_on_grids(rows.select("px", "py"), levels).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _CROWD).select(*key, F.ceil(F.col("_n") / _CROWD).alias("_parts")), "full")
    many = not crowded.isEmpty()
    carried = measured.join(crowded, ["polygon_id", "iy"], "left_anti") if many else measured
    near = carried.groupBy("polygon_id", "iy").agg(F.collect_list("edge").alias("near"), F.first("c").alias("c"), F.first("pad").alias("pad")).withColumn("border", F.lit(True))
    own = _narrowed(cells.join(near, ["polygon_id", "iy", "border"], "left").where("near is not null or not border"))
    own = own.join(lists.withColumnRenamed("class_id", "polygon_id"), "polygon_id").select(*key, "near", "odd", "ids")
    each = _on_grids(rows, levels)
    if not full.isEmpty():
        own = own.join(full, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)))
        each = each.join(full, key, "left").withColumn("_part", F.pmod("_hash", F.coalesce("_parts", F.lit(1))))
        key = [*key, "_part"]
    each = each.select("_row", "px", "py", *key)
    own, each = (df.withColumn("level", -F.col("level")).repartition(tasks, *key) for df in (own, each))  # large cells come first, as most results are theirs and a file's dictionary has room for the first polygons only
    met = own.join(each, key)
    out = met.where(F.col("near").isNull() | _inside(px, py, eps)).select("_row.*", F.explode("ids").alias("polygon_id"))
    if many:
        heavy = cells.where("border").join(crowded, ["polygon_id", "iy"])
        held = _held_by_rows(rows.select("px", "py").repartition(tasks, "px", "py"), heavy, measured.join(crowded, ["polygon_id", "iy"]), levels, eps)
        found = rows.select("_row", "px", "py").repartition(tasks, "px", "py").join(held.withColumnRenamed("polygon_id", "class_id"), ["px", "py"]).select("_row", "class_id")
        out = out.union(found.join(lists, "class_id").select("_row.*", F.explode("ids").alias("polygon_id")))
    return out
