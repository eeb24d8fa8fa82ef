"""Text files as line tables (file, ln, line), and the moves that all text readers share.

`file_lines` numbers the lines of files of any size from their splits; `text_lines` makes a file one row until it is cut and is for many
files of a few MB each; `loose_lines` is for bodies whose rows carry their own keys. Carried values and counts inside a file are scans over chunks
of lines (operators/scan.py): no task needs a whole file.

Readers take whole=True for line tables of texts that were one row each (text_lines, split_lines): then marks and counts are windows by file, which share one sort, and the lines are
read once. Without it they are grouped and joined, for files of any size, and the lines are read for each of these."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..plans.scratch import new_folder

#: Rows up to which the table of splits is broadcast; beyond that it is joined by shuffle.
SPLITS = 1 << 19


def text_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_lines(whole, "file", "value")


def file_lines(spark: SparkSession, path: str, recursive: bool = False, parts: bool = False) -> DataFrame:
    """(file, ln, line) as text_lines gives it, but for the empty piece after a final line end, which is no line here.

    A file is read split by split. A line's number is the number of lines in the splits before its own and of those before it there: a first pass counts the lines of each
    split, a sum over a file's splits follows, and the second pass adds it. Row numbers within a task come from the scan itself, so nothing is sorted.
    parts: the files of a folder are one text in the order of their names, as Spark writes a large one, and `file` is the folder with its last slash."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(path)
    part = F.col("_metadata.file_path")
    at = rows.select((F.regexp_replace(part, "[^/]*$", "") if parts else part).alias("file"), part.alias("_part"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    folder = new_folder(spark, "splits")
    at.groupBy("file", "_part", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).write.parquet(folder)
    splits = spark.read.parquet(folder)
    earlier = Window.partitionBy("file").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_part", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_add"))
    starts = F.broadcast(starts) if splits.count() <= SPLITS else starts
    return at.join(starts, ["_part", "_block"]).select("file", (F.col("_id") + F.col("_add")).alias("ln"), F.regexp_replace("value", "\r$", "").alias("line"))


def split_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(file, ln, line) of a text column; ln from 0; a carriage return at the end of a line is dropped."""
    pieces = F.split(text, "\n")
    return texts.select(F.col(key).alias("file"), F.posexplode(F.when(F.contains(F.col(text), F.lit("\r")), F.transform(pieces, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(pieces)).alias("ln", "line"))


def loose_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def tokens(line: Column) -> Column:
    """The words of a line; an empty array for a blank one. Lines with single spaces only, most of them, are cut without a pattern."""
    t = F.trim(line)
    has = [F.contains(t, F.lit(c)) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")]
    return F.when(t == "", F.array().cast("array<string>")).when(~reduce(or_, has), F.split(t, " ")).otherwise(F.split(t, r"\s+"))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once for each: as a generated column it is not copied into the filters on it, as an expensive value of withColumn would be."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def number(text: Column) -> Column:
    """A lenient number: null for anything else. Fortran's D exponents count."""
    return F.translate(text, "dD", "ee").try_cast("double")


def last_value(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """(file, name): the last line on which the value is there."""
    return lines.withColumn(name, value).where(F.col(name).isNotNull()).groupBy("file").agg(F.max_by(name, "ln").alias(name))


def marked(lines: DataFrame, marks: dict[str, Column], whole: bool = False, key: str = "file", order: str = "ln") -> DataFrame:
    """lines with aggregates over all lines of their file, by name."""
    if whole:
        of_file = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered, to share the sort of scans
        return lines.withColumns({name: value.over(of_file) for name, value in marks.items()})
    return lines.join(lines.groupBy(key).agg(*[value.alias(name) for name, value in marks.items()]), key)


def block(lines: DataFrame, start: Column, end: Column, whole: bool = False) -> DataFrame:
    """The lines between the last start and the last end marker of each file; comments (#) and blanks dropped."""
    marks = {"_s": F.max(F.when(start, F.col("ln"))), "_e": F.max(F.when(end, F.col("ln")))}
    inside = marked(lines, marks, whole).where((F.col("ln") > F.col("_s")) & (F.col("ln") < F.col("_e"))).drop("_s", "_e")
    return inside.where((F.trim("line") != "") & ~F.startswith(F.trim(F.col("line")), F.lit("#")))


def named_block(lines: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """A block `<name ... name>`."""
    return block(lines, F.startswith(F.trim(F.col("line")), F.lit(f"<{name}")), F.startswith(F.trim(F.col("line")), F.lit(f"{name}>")), whole)


def after_until(lines: DataFrame, anchor: Column, skip: int, stop: Column, whole: bool = False) -> DataFrame:
    """The lines from `skip` lines after the last anchor up to the first one for which stop holds."""
    if whole:
        tail = marked(lines, {"_at": F.max(F.when(anchor, F.col("ln")))}, whole).where(F.col("ln") >= F.col("_at") + skip)
        return marked(tail, {"_stop": F.min(F.when(stop, F.col("ln")))}, whole).where(F.col("_stop").isNull() | (F.col("ln") < F.col("_stop"))).drop("_at", "_stop")
    at = lines.where(anchor).groupBy("file").agg((F.max("ln") + skip).alias("_from"))
    tail = lines.join(at, "file").where(F.col("ln") >= F.col("_from"))
    first = tail.where(stop).groupBy("file").agg(F.min("ln").alias("_stop"))
    return tail.join(first, "file", "left").where(F.col("_stop").isNull() | (F.col("ln") < F.col("_stop"))).drop("_from", "_stop")


def carried(lines: DataFrame, value: Column, name: str, key: str = "file", order: str = "ln", size: int | None = scan.CHUNK) -> DataFrame:
    """lines with the latest non-null value up to each line."""
    return scan.running_last(lines, [key], order, value, name, size)


def numbered(lines: DataFrame, is_start: Column, name: str = "record", key: str = "file", order: str = "ln", size: int | None = scan.CHUNK) -> DataFrame:
    """lines with the number of starts up to each line: the record that it belongs to (0: before the first)."""
    return scan.running_sum(lines, [key], order, F.when(is_start, 1).otherwise(0), name, size).withColumn(name, F.col(name).cast("int"))


def nth(lines: DataFrame, name: str = "nth", key: str = "file", size: int | None = scan.CHUNK) -> DataFrame:
    """lines with their number among the lines that are there."""
    return numbered(lines, F.lit(True), name, key, size=size)


def ranked_sources(files: DataFrame, preference: dict[str, int], system: Column, suffix: Column) -> DataFrame:
    """(system, file): the preferred file of each system by its suffix; suffixes that are not listed are left out."""
    rank = F.coalesce(*[F.when(suffix == s, F.lit(r)) for s, r in preference.items()])
    best = files.withColumn("_r", rank).where(F.col("_r").isNotNull()).groupBy(system.alias("system")).agg(F.min(F.struct("_r", "file")).alias("b"))
    return best.select("system", F.col("b.file").alias("file"))
