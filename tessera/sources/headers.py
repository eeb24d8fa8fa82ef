"""Instrument headers as (file, key, value), in three dialects, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import grid_dimension
from . import lines as L


def _joined(rows: DataFrame, sep: str = "\n") -> DataFrame:
    """(file, key, value): the pieces of each key in line order, as one value."""
    parts = F.sort_array(F.collect_list(F.struct("ln", "piece")))  # the lines of one header entry
    return rows.groupBy("file", "key").agg(parts.alias("p")).select("file", "key", F.array_join("p.piece", sep).alias("value"))


def _keyed(lines: DataFrame, own: Column, end: str, whole: bool) -> DataFrame:
    """The lines before the first end marker of each file (all where there is none) with the latest key, from the lines that name one; those above it are left out. whole: see lines.marked."""
    if whole:  # keys are carried downwards, so the lines that the end marker cuts off change none above it: both in one round of windows
        of_file = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        head = lines.withColumns({"_end": F.min(F.when(F.trim("line") == end, F.col("ln"))).over(of_file), "key": F.last(own, ignorenulls=True).over(of_file.rowsBetween(Window.unboundedPreceding, 0))})
        return head.where((F.col("_end").isNull() | (F.col("ln") < F.col("_end"))) & F.col("key").isNotNull()).drop("_end")
    stop = lines.where(F.trim("line") == end).groupBy("file").agg(F.min("ln").alias("_end"))
    head = lines.join(stop, "file", "left").where(F.col("_end").isNull() | (F.col("ln") < F.col("_end"))).drop("_end")
    return L.carried(head, own, "key").where("key is not null")


def colon_blocks(lines: DataFrame, end: str = ":SCANIT_END:", whole: bool = False) -> DataFrame:
    """`:KEY:` on a line of its own, its content on the lines below, up to the end marker."""
    own = F.when(F.startswith(F.col("line"), F.lit(":")), F.regexp_extract("line", r"^:([^:].*):\s*$", 1))
    key = F.coalesce("_key", F.lit(""))
    keyed = _keyed(lines.withColumn("_key", own), F.when(key != "", key), end, whole)
    return _joined(keyed.withColumn("piece", F.when(key == "", F.trim("line"))).withColumn("piece", F.coalesce("piece", F.lit(""))).where((F.col("piece") != "") | (key != ""))).withColumn("value", F.ltrim(F.regexp_replace("value", "^\n", "")))


def tab_pairs(lines: DataFrame, end: str = "[DATA]", whole: bool = False) -> DataFrame:
    """`key<TAB>value<TAB>` lines; a line without a tab continues the value above it."""
    fields = F.split("line", "\t")
    is_key = F.size(fields) > 1
    keyed = _keyed(lines.where("line <> ''"), F.when(is_key, fields[0]), end, whole)
    return _joined(keyed.withColumn("piece", F.when(is_key, fields[1]).otherwise(F.col("line"))))


def equals_pairs(lines: DataFrame, end: str = ":HEADER_END:", whole: bool = False) -> DataFrame:
    """`key=value` lines, quotation marks around the value dropped; a line without `=` continues the value above it."""
    key = F.col("_key")
    keyed = _keyed(lines.where("line <> ''").withColumn("_key", F.regexp_extract("line", r"^([^=]+)=", 1)), F.when(key != "", key), end, whole)
    piece = F.when(key != "", F.regexp_replace(F.regexp_replace("line", r"^[^=]+=", ""), '^"|"$', "")).otherwise(F.col("line"))
    return _joined(keyed.withColumn("piece", piece))


def modules(header: DataFrame) -> DataFrame:
    """(file, module, key, value, single): `Module>key` parted; an `Ext. VI n>` in front is dropped; a module with one key is single."""
    plain = F.regexp_replace("key", r"^Ext\. VI \d+>", "")
    parted = header.select("file", F.split(plain, ">").alias("p"), "value")
    rows = parted.select("file", F.element_at("p", 1).alias("module"), F.when(F.size("p") > 1, F.array_join(F.slice("p", 2, 100), ">")).alias("key"), "value")
    return rows.withColumn("single", F.count(F.lit(1)).over(Window.partitionBy("file", "module")) == 1)


def nested(rows: DataFrame) -> DataFrame:
    """(file, header map<module, map<key, value>>); the key of an entry without one is empty."""
    per = rows.groupBy("file", "module").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("key", F.lit("")).alias("k"), "value")))).alias("m"))
    return per.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("module", F.to_json("m").alias("m"))))).alias("j")).select("file", F.transform_values("j", lambda k, v: F.from_json(v, "map<string,string>")).alias("header"))


def embedded(rows: DataFrame, row_sep: str = "\n", field_sep: str = "\t") -> DataFrame:
    """(file, section, row, column, value): tables inside values, their first row the column names. Rows of another width are dropped."""
    each = rows.select("file", F.col("key").alias("section"), F.posexplode(F.split("value", row_sep)).alias("row", "text"))
    cells = each.withColumn("f", F.split(F.regexp_replace("text", f"^{field_sep}+|{field_sep}+$", ""), field_sep))
    names = cells.where("row = 0").select("file", "section", F.col("f").alias("names"))
    body = cells.where("row > 0").join(names, ["file", "section"]).where(F.size("f") == F.size("names"))
    return body.select("file", "section", "row", F.explode(F.arrays_zip("names", "f")).alias("c")).select("file", "section", "row", F.trim("c.names").alias("column"), F.trim("c.f").alias("value"))


def first_of(header: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """One row for each file, a column for each name: the value of the first of its keys that is there."""
    picks = {n: F.coalesce(*[F.max(F.when(F.col("key") == k, F.col("value"))) for k in keys]).alias(n) for n, keys in names.items()}
    return header.groupBy("file").agg(*picks.values())


def image_metadata(header: DataFrame) -> DataFrame:
    """Typed metadata of scan images. Ranges and centres are as stored."""
    raw = first_of(header, {"pixels": ["SCAN_PIXELS"], "range": ["SCAN_RANGE"], "offset": ["SCAN_OFFSET"], "angle": ["SCAN_ANGLE"], "dir": ["SCAN_DIR"], "bias": ["BIAS"]})
    part = lambda c, i: F.get(L.tokens(F.col(c)), F.lit(i))
    return raw.select("file", part("pixels", 0).try_cast("int").alias("nx"), part("pixels", 1).try_cast("int").alias("ny"), *[part("range", i).try_cast("double").alias(f"range_{c}") for i, c in enumerate("xy")], *[part("offset", i).try_cast("double").alias(f"centre_{c}") for i, c in enumerate("xy")], F.trim("angle").try_cast("double").alias("angle"), F.trim("dir").alias("direction"), F.trim("bias").try_cast("double").alias("bias"))


def grid_metadata(header: DataFrame) -> DataFrame:
    """Typed metadata of spectrum grids."""
    raw = first_of(header, {"dim": ["Grid dim"], "points": ["Points"], "channels": ["Channels"], "params": ["# Parameters (4 byte)"], "fixed": ["Fixed parameters"], "experiment": ["Experiment parameters"]})
    return raw.select("file", grid_dimension(F.col("dim"), 1).alias("nx"), grid_dimension(F.col("dim"), 2).alias("ny"), F.col("points").try_cast("int").alias("points"), F.split("channels", ";").alias("channels"), F.col("params").try_cast("int").alias("n_params"), F.filter(F.concat(_names("fixed"), _names("experiment")), lambda x: x != "").alias("param_names"))


def _names(c: str) -> Column:
    return F.coalesce(F.split(c, ";"), F.array().cast("array<string>"))
