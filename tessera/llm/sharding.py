"""Sharding by sampled splitters: near equal sizes (the law `bytes`).

Records have the key (hash of the text, doc_id). A size-weighted sample of keys is drawn, its quantiles become the
boundaries of ranges, and records are range-partitioned by them; a range that turns out overfull gets a sample of its
own and is subdivided. The key order then gives each record its exact offset in bytes and rows: the sum over the ranges before its
own plus a running sum within it. A record's shard follows from the middle of its bytes on the scale of all bytes.

Copies of a text are neighbours in the key order and share a shard. Groups of copies and single records of more than 1 / LARGE of a mean shard are placed
first, the largest first, each on the least loaded shard; all others fill the shards up to one level in key order, a group that lies across the end of a shard going to
the side of its middle. Only a group larger than a mean shard is dealt record by record. Shard sizes thus differ by no more than about 1 / LARGE of the mean
or one record, unless a single record or group is itself larger than that level.

Scale: texts are read once, into a narrow table. The driver sorts a sample of PER_RANGE keys a range (one range for each ROWS_PER_RANGE rows, 8 for
each shard at least), and places at most LARGE large groups for each shard; both are bounded by these parameters and what is broadcast is no larger. A range is what one task sorts; a range that
is overfull is subdivided until each is of bounded size or holds a single key, so that a text that a third of the rows share spans many ranges (doc_id is part of the key).

Edge cases: a null or empty text has 16 bytes and crc 0; null doc_ids sort first among copies; repeated rows are records like others;
shards may stay empty when there are fewer records; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, row_key, small, table, written

OVERHEAD = 16
PER_RANGE = 16
ROWS_PER_RANGE = 1_000_000
OVERFULL = 2.0
LARGE = 64


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    text = F.col(text_col)
    doc_id = F.col(id_col).cast("long")
    return written(
        docs.select(
            doc_id.alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            (F.col(key_col) if key_col else row_key(doc_id, text)).alias("key"),
        ).withColumn("same", F.substring("key", 1, 16)),
        "shard-keys",
    )


def _sample(rows: DataFrame, rate: float, seed: int) -> pd.DataFrame:
    """Keys drawn with chance size * rate, and the weight of each (more than 1 where that exceeds 1)."""
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    chosen = rows.where(draw < F.col("size") * rate)
    return chosen.select("key", F.greatest(F.lit(1.0), F.col("size") * rate).alias("weight")).toPandas().sort_values("key")


def _quantiles(sample: pd.DataFrame, n: int) -> list[str]:
    """n - 1 keys that cut the sample into parts of near equal weight."""
    if not len(sample):
        return []
    upto = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return sorted(set(sample["key"].to_numpy()[np.minimum(at, len(sample) - 1)]))


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(np.array(splitters, "U64"))  # a few keys for each range

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, key.to_numpy().astype("U64"), side="right").astype(np.int32))

    return rows.withColumn("range", range_of("key"))


def split_ranges(rows: DataFrame, n: int, total: int, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """rows with their range, and each range's bytes and rows. Overfull ranges are subdivided until none is left that a sample of its own can cut."""
    splitters = _quantiles(_sample(rows, PER_RANGE * n / max(1, total), seed), n)
    turn = 0
    while True:
        ranged = _ranged(rows, splitters)
        stats = written(ranged.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count(F.lit(1)).alias("range_rows"), (F.min("key") < F.max("key")).alias("several")), "shard-ranges")
        over = [r["range"] for r in stats.where("several").where(F.col("range_bytes") > OVERFULL * total / n).select("range").collect()]  # fewer than n / 2
        if not over:
            return ranged, stats
        inside = ranged.where(F.col("range").isin(over))
        more = _sample(inside, 4 * PER_RANGE * n / max(1, total) * (turn + 1), seed + turn + 1)
        of = np.searchsorted(np.array(splitters, "U64"), more["key"].to_numpy().astype("U64"), side="right")
        fresh = [k for r in over for k in _quantiles(more[of == r], 2 + round(more["weight"][of == r].sum() / (4 * PER_RANGE)))]
        if not set(fresh) - set(splitters):
            return ranged, stats
        splitters = sorted({*splitters, *fresh})
        discard(stats)
        turn += 1


def placed_first(large: list[tuple[str, int, int]], shards: int, total: int) -> tuple[list[tuple[str, int]], list[str], list[int]]:
    """large: (name, bytes, records) of groups. Returns the groups with their shards, the groups to be dealt by record, and the upper ends of the shards on the scale of all other bytes."""
    load, whole, dealt = [(0, s) for s in range(shards)], [], []
    for name, size, n in sorted(large, key=lambda g: (-g[1], g[0])):
        if n > 1 and size * shards > total:
            dealt.append(name)
            continue
        least, s = heapq.heappop(load)
        heapq.heappush(load, (least + size, s))
        whole.append((name, s))
    loads = np.array([x for x, _ in sorted(load, key=lambda p: p[1])], float)
    rest = total - loads.sum()
    low = np.sort(loads)
    levels = (rest + np.cumsum(low)) / np.arange(1, shards + 1)  # if only the k least loaded shards get any
    level = next((float(v) for k, v in enumerate(levels) if k + 1 == shards or v <= low[k + 1]), 0.0)
    return whole, dealt, np.rint(np.cumsum(np.maximum(0.0, level - loads))).astype(np.int64).tolist()


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, key (see common.row_key, or key_col, which starts with 16 characters that name the text) of every row."""
    spark, rows = docs.sparkSession, keyed(docs, id_col, text_col, key_col)
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where(F.col("bytes") * (LARGE * shards) > total)
    whole, dealt, ends = placed_first([tuple(r) for r in groups.collect()], shards, total)  # fewer than LARGE * shards
    rows = rows.join(F.broadcast(spark.createDataFrame(whole, "same string, own int")), "same", "left").withColumn("weight", F.when(F.col("own").isNull(), F.col("size")).otherwise(F.lit(0)))
    n = max(8 * shards, n_rows // ROWS_PER_RANGE)
    ranged, stats = split_ranges(rows, n, total)
    ranged = written(ranged, "shard-ranged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("range").agg(F.sum("weight").alias("w")).select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    held = spark.sparkContext.broadcast(np.array(ends, np.int64))

    @F.pandas_udf("int")
    def shard_at(twice: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(2 * held.value, twice.to_numpy(), side="right"), len(held.value) - 1).astype(np.int32))

    at = ranged.join(F.broadcast(starts), "range").withColumn("at", F.col("start") + F.sum("weight").over(inside) - F.col("weight"))  # narrow rows, one for each range
    at = written(at.withColumn("shard", F.coalesce("own", shard_at(2 * F.col("at") + F.col("weight")))), "shard-at")
    across = at.where("own is null").groupBy("same").agg(F.sum("size").alias("bytes"), F.min("at").alias("first"), F.min("shard").alias("low"), F.max("shard").alias("high")).where("low < high")
    if dealt:
        across = across.join(F.broadcast(spark.createDataFrame([(d,) for d in dealt], "same string")), "same", "left_anti")
    across = written(across.select("same", shard_at(2 * F.col("first") + F.col("bytes")).alias("to")), "shard-across")  # fewer than shards
    out = at.join(F.broadcast(across), "same", "left").withColumn("shard", F.coalesce("to", "shard"))
    out = written(out.select("doc_id", "size", "text_crc32", "range", "shard", "key"), "shard-out")
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = out.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "size"))
    numbered = out.withColumn("nth", nth).join(small(written(firsts, "shard-firsts")), ["shard", "range"])
    for t in (stats, ranged, at, across):
        discard(t)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "key")


def op7_byte_shards(spark, sf_dir) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).drop("key")
