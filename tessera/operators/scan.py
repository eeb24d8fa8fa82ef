"""Running values inside long groups: a segmented scan of two levels.

A group (a file, a path) is cut into chunks of at most `size` order numbers. A window works inside a chunk; what the chunks before it hold
is combined over one row for each chunk. So no task needs a whole group, as a window over it would. The combines are associative: sums, and the last
value that is there.

size=None is for groups known to be small, such as files whose text was one row: one window by group, and the rows are read once and met with nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers of a chunk.
CHUNK = 1 << 16


def _chunked(rows: DataFrame, order: str, value: Column, size: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)).cast("long")).withColumn("_x", value)


def _local(keys: list[str], order: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _whole(keys: list[str], order: str, end: int = 0):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int | None = CHUNK, inclusive: bool = True) -> DataFrame:
    """rows with the sum of value up to each row of its group (keys) by a whole-number order; inclusive=False: without the row itself. Nulls add nothing."""
    if size is None:
        return rows.withColumn(name, F.coalesce(F.sum(value).over(_whole(keys, order, 0 if inclusive else -1)), F.lit(0)))
    each = _chunked(rows, order, value, size)
    sums = each.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_s"))
    before = sums.select(*keys, "_chunk", F.sum("_s").over(_earlier(keys)).alias("_before"))
    own = F.lit(0) if inclusive else F.coalesce("_x", F.lit(0))
    total = F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0)) - own
    out = each.withColumn("_own", F.sum("_x").over(_local(keys, order))).join(before, [*keys, "_chunk"], "left")
    return out.withColumn(name, total).select(*dict.fromkeys([*rows.columns, name]))


def running_last(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int | None = CHUNK) -> DataFrame:
    """rows with the latest value that is not null up to each row of its group."""
    if size is None:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(_whole(keys, order)))
    each = _chunked(rows, order, value, size)
    held = each.where(F.col("_x").isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by("_x", order).alias("_s"))
    chunks = each.select(*keys, "_chunk").distinct().join(held, [*keys, "_chunk"], "left")
    before = chunks.select(*keys, "_chunk", F.last("_s", ignorenulls=True).over(_earlier(keys)).alias("_before"))
    out = each.withColumn("_own", F.last("_x", ignorenulls=True).over(_local(keys, order))).join(before, [*keys, "_chunk"], "left")
    return out.withColumn(name, F.coalesce("_own", "_before")).select(*dict.fromkeys([*rows.columns, name]))
