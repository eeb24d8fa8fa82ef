"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

All DataFrame operations. Sources get weights; targets share all tokens by weight, capped at a multiple of a source's
own size. The mix is a sequence of equal blocks of tokens, cut into shards; a source's number of blocks up to each
shard's end is its Sainte-Lague share of all blocks up to there, so that every shard has integer quotas and the
quotas of all shards add up to the share of the whole. A source's documents stand in a seeded order as one stream of
tokens (the seeded selection of its blocks: the stream's consecutive pieces); each shard takes its quota of them where the shard before stopped, and the stream starts
again at its end. What a document gives to each shard follows from the shards' ends on its source's stream.

Scale: documents are read once into a narrow table (id, source, size, order). The prefix sums over a source's stream
have two levels, the seeded order's leading digits and the documents below each, so that no source is a single group.
Tables by source are small dimensions. Nothing is broadcast by hint or collected.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, after all others;
sources without tokens have target 0; an empty table gives an empty result; repeated rows are rows like others; rows without
an id are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

CAP = 3
BLOCKS = 1 << 20


def sized(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, and h, the seeded order of the documents; kept as a table."""
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))).alias("h"),
        ).select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "size", "h"),
        "mix-sized",
    )


def _parts(base: DataFrame, digits: int) -> DataFrame:
    return base.groupBy("skey", F.substring("h", 1, digits).alias("part")).agg(F.sum("size").alias("part_size"), F.first("source").alias("source"))


def targets(parts: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per source: its size, rank by code point (null last), weight (repeating) and target; the excess over the cap is shared again by weight.

    Sources in order of cap / weight: the first that stays under its cap, given that all before it are at theirs, fixes the level."""
    src = parts.groupBy("skey").agg(F.sum("part_size").alias("source_size"), F.first("source").alias("source"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    before, all_of = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        src.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_of))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.col("nth"))).over(all_of))
        .withColumn("at_level", F.min(F.when(F.col("nth") == F.col("first_free"), F.col("level"))).over(all_of))
        .select("skey", "source", "rank", "weight", "source_size", "most", "total", F.when(F.col("nth") < F.col("first_free"), F.col("most").cast("double")).otherwise(F.col("at_level") * F.col("weight")).alias("target"))
    )


def quotas(goal: DataFrame, blocks: int = BLOCKS, shards: int = 16) -> DataFrame:
    """Per source and shard: the blocks of the source in the shard and in all shards so far, with the tokens of a block.

    Seats of the first b blocks: the b highest quotients target / (2 k + 1), k = 0, 1, ... Rounding each source's exact share gives
    almost all of them; the few seats that are then missing or over are found among the next quotients. No source needs more of them
    than its part of (missing + sources), plus two, so that the candidates number a few times the sources, however many blocks there are."""
    each = (
        goal.withColumn("block", F.expr(f"greatest(1, total div {blocks})"))
        .withColumn("house", F.expr("total div block"))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.expr(f"house * shard div {shards}"))
        .withColumn("part", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0)))
        .withColumn("base", F.floor(F.col("house") * F.col("part") + 0.5))
        .withColumn("missing", F.col("house") - F.sum("base").over(Window.partitionBy("shard")))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shard")))
    )
    near = (
        each.where((F.col("target") > 0) & (F.col("missing") != 0))
        .withColumn("reach", (F.ceil(F.col("part") * (F.abs("missing") + F.col("n"))) + 1).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("reach"))))
        .withColumn("k", F.when(F.col("missing") > 0, F.col("base") + F.col("i") - 1).otherwise(F.col("base") - F.col("i")))
        .where("k >= 0")
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    )
    sign = F.signum("missing")
    order = Window.partitionBy("shard").orderBy((-F.col("quotient") * sign), F.col("rank") * sign)
    moved = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.abs("missing")).groupBy("shard", "skey").agg(F.sum(sign).cast("long").alias("moved"))
    upto = Window.partitionBy("skey").orderBy("shard")
    return (
        each.join(moved, ["shard", "skey"], "left")
        .withColumn("blocks_so_far", F.col("base").cast("long") + F.coalesce("moved", F.lit(0)))
        .select("skey", "source", (F.col("shard") - 1).alias("shard"), (F.col("blocks_so_far") - F.coalesce(F.lag("blocks_so_far").over(upto), F.lit(0))).alias("blocks"), "blocks_so_far", F.col("block").alias("block_tokens"))
    )


def _read(upto: str) -> str:
    """SQL: the tokens of a document among the first `upto` that are read from its source's stream."""
    return f"if(source_size > 0, size * ({upto} div source_size) + greatest(0L, least(at + size, {upto} % source_size) - at), 0L)"


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, blocks: int = BLOCKS, shards: int = 16, seed: int = 7, digits: int = 3, **names: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (tokens of the document in the mix, repeats counted), reads (the same for each shard). 16**digits leading parts of the order."""
    base = sized(docs, seed, **names)
    parts = written(_parts(base, digits), "mix-parts")
    goal = written(targets(parts, weights, cap), "mix-goal")
    ends = quotas(goal, blocks, shards).groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("shard", (F.col("blocks_so_far") * F.col("block_tokens")).alias("upto")))).alias("ends"))  # one for each shard
    per_source = goal.join(ends, "skey").select("skey", "source_size", "target", F.transform("ends", lambda e: F.least(e["upto"], F.col("most"))).alias("ends"))
    upto = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).select("skey", "part", "start").join(per_source, "skey")
    inside = Window.partitionBy("skey", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        base.withColumn("part", F.substring("h", 1, digits))
        .join(starts, ["skey", "part"])
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("so_far", F.expr(f"transform(ends, upto -> {_read('upto')})"))
        .withColumn("reads", F.expr("transform(so_far, (x, k) -> if(k = 0, x, x - so_far[k - 1]))"))
        .select("doc_id", "size", "source_size", "target", F.element_at("so_far", -1).alias("taken"), "reads")
    )


def op4_source_mix(spark, sf_dir) -> DataFrame:
    """first_shard: the first shard that reads the document (null: none does); n_shards: how many do."""
    mixed = mix(table(spark, sf_dir, "documents"))
    first = F.array_position(F.transform("reads", lambda x: x > 0), True).cast("int") - 1
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.when(first >= 0, first).alias("first_shard"), F.size(F.filter("reads", lambda x: x > 0)).alias("n_shards"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM r),
o AS (SELECT *, CAST(most AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, rank) AS nth,
    CAST(total - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM o),
f AS (SELECT *, min(CASE WHEN level * weight <= most THEN nth END) OVER () AS first_free FROM l),
g AS (
  SELECT source, rank, weight, source_size, most, total,
    CASE WHEN nth < first_free THEN CAST(most AS DOUBLE) ELSE (SELECT level FROM f WHERE nth = first_free) * weight END AS target
  FROM f),
e AS (
  SELECT *, greatest(1, total // 1048576) AS block, (total // greatest(1, total // 1048576)) * k // 16 AS house, k AS shard,
    CASE WHEN total > 0 THEN target / total ELSE 0 END AS part FROM g, range(1, 17) AS u(k)),
b AS (SELECT *, CAST(floor(house * part + 0.5) AS BIGINT) AS base FROM e),
m AS (SELECT *, CAST(house - sum(base) OVER (PARTITION BY shard) AS BIGINT) AS missing, count(*) OVER (PARTITION BY shard) AS n FROM b),
c AS (
  SELECT source, rank, shard, missing, CASE WHEN missing > 0 THEN base + i - 1 ELSE base - i END AS k, target
  FROM m, unnest(range(1, CAST(ceil(part * (abs(missing) + n)) AS BIGINT) + 2)) AS u(i) WHERE target > 0 AND missing <> 0),
p AS (
  SELECT source, shard, sign(missing) AS sgn, missing,
    row_number() OVER (PARTITION BY shard ORDER BY -(target / (2 * k + 1)) * sign(missing), rank * sign(missing)) AS nth FROM c WHERE k >= 0),
v AS (SELECT source, shard, CAST(sum(sgn) AS BIGINT) AS moved FROM p WHERE nth <= abs(missing) GROUP BY source, shard),
t AS (
  SELECT m.source, m.shard, source_size, target, least((base + coalesce(moved, 0)) * block, most) AS tokens
  FROM m LEFT JOIN v ON m.source IS NOT DISTINCT FROM v.source AND m.shard = v.shard),
a AS (SELECT *, row_number() OVER () AS row, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos FROM d),
x AS (
  SELECT row, doc_id, size, source_size, target, shard,
    CAST(CASE WHEN source_size > 0 THEN size * (tokens // source_size) + greatest(0, least(pos + size, tokens % source_size) - pos) ELSE 0 END AS BIGINT) AS upto
  FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY row ORDER BY shard), 0) AS got FROM x)
SELECT doc_id, size, source_size, target, max(upto) AS taken, CAST(min(CASE WHEN got > 0 THEN shard - 1 END) AS INTEGER) AS first_shard,
  CAST(count(CASE WHEN got > 0 THEN 1 END) AS INTEGER) AS n_shards
FROM y GROUP BY row, doc_id, size, source_size, target
"""
