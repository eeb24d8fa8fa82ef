"""The given tables read as grids, spectra, lattices and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark, sf_dir: str, n: int = 16) -> DataFrame:
    """(layer, i, j, v): quantities summed by line number, part and supplier modulo n."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("layer"), (F.col("l_partkey") % n).cast("int").alias("i"), (F.col("l_suppkey") % n).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))


def grid_sql(n: int = 16) -> str:
    return f"g AS (SELECT CAST(l_linenumber AS INTEGER) AS layer, CAST(l_partkey % {n} AS INTEGER) AS i, CAST(l_suppkey % {n} AS INTEGER) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def full_sql(n: int = 16) -> str:
    cells = f"SELECT layer, CAST(x AS INTEGER) AS i, CAST(y AS INTEGER) AS j FROM (SELECT DISTINCT layer FROM g) l, range({n}) AS a(x), range({n}) AS b(y)"
    return f"m AS ({cells}), f AS (SELECT m.layer, m.i, m.j, coalesce(v, 0) AS v FROM m LEFT JOIN g ON m.layer = g.layer AND m.i = g.i AND m.j = g.j)"


def matrices(spark, sf_dir: str) -> DataFrame:
    """(layer, i, j, a, b, re, im): complex 2 x 2 matrices on an 8 x 8 mesh, whole numbers."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_linenumber").cast("int").alias("layer"), (F.col("l_partkey") % 8).cast("int").alias("i"), (F.col("l_suppkey") % 8).cast("int").alias("j"), (F.col("l_orderkey") % 2).cast("int").alias("a"), F.expr("cast((l_orderkey div 2) % 2 as int)").alias("b")]
    return li.groupBy(*keys).agg(F.sum("l_quantity").alias("re"), F.sum("l_linenumber").cast("double").alias("im"))


MATRICES_SQL = "c AS (SELECT CAST(l_linenumber AS INTEGER) AS layer, CAST(l_partkey % 8 AS INTEGER) AS i, CAST(l_suppkey % 8 AS INTEGER) AS j, CAST(l_orderkey % 2 AS INTEGER) AS a, CAST((l_orderkey // 2) % 2 AS INTEGER) AS b, sum(l_quantity) AS re, CAST(sum(l_linenumber) AS DOUBLE) AS im FROM lineitem GROUP BY ALL)"


def bands(spark, sf_dir: str) -> DataFrame:
    """(i, j, band, energy): mean balances in thousands."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_custkey") % 8).cast("int").alias("i"), F.expr("cast((c_custkey div 8) % 8 as int)").alias("j"), F.expr("cast((c_custkey div 64) % 3 as int)").alias("band")).agg((F.avg(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / 1000).alias("energy"))


BANDS_SQL = "e AS (SELECT CAST(c_custkey % 8 AS INTEGER) AS i, CAST((c_custkey // 8) % 8 AS INTEGER) AS j, CAST((c_custkey // 64) % 3 AS INTEGER) AS band, avg(c_acctbal) / 1000 AS energy FROM customer GROUP BY ALL)"


def hopping(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = [F.lit("t").alias("system_id"), (F.col("l_linenumber") - 4).cast("int").alias("r1"), (F.col("l_partkey") % 5 - 2).cast("int").alias("r2"), F.lit(0).alias("r3"), (F.col("l_partkey") % 3).cast("int").alias("m"), (F.col("l_suppkey") % 3).cast("int").alias("n")]
    out = li.groupBy(*keys).agg(F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double").alias("re"), F.sum(F.col("l_tax").cast("decimal(12,2)")).cast("double").alias("im"))
    return out.withColumn("ndegen", (1 + F.pmod(F.col("r1") + 4, F.lit(2))).cast("double"))


HOPPING_SQL = "h AS (SELECT CAST(l_linenumber - 4 AS INTEGER) AS r1, CAST(l_partkey % 5 - 2 AS INTEGER) AS r2, CAST(l_partkey % 3 AS INTEGER) AS m, CAST(l_suppkey % 3 AS INTEGER) AS n, CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS re, CAST(sum(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) AS im, CAST(1 + l_linenumber % 2 AS DOUBLE) AS ndegen FROM lineitem GROUP BY ALL)"


def lattices(spark, sf_dir: str) -> DataFrame:
    """(system_id, a1x .. a3z): one lattice for each supplier, none singular."""
    k = F.col("s_suppkey")
    cols = {"a1x": 1 + k % 5, "a1y": (k % 3) / 4, "a1z": F.lit(0.0), "a2x": (k % 4) / 4, "a2y": 2 + k % 7, "a2z": F.lit(0.0), "a3x": F.lit(0.0), "a3y": F.lit(0.0), "a3z": 1 + k % 2}
    return table(spark, sf_dir, "supplier").select(k.alias("system_id"), *[v.cast("double").alias(c) for c, v in cols.items()])


LATTICES_SQL = "l AS (SELECT s_suppkey AS system_id, CAST(1 + s_suppkey % 5 AS DOUBLE) AS a1x, (s_suppkey % 3) / 4 AS a1y, (s_suppkey % 4) / 4 AS a2x, CAST(2 + s_suppkey % 7 AS DOUBLE) AS a2y, CAST(1 + s_suppkey % 2 AS DOUBLE) AS a3z FROM supplier)"


def lines(spark, sf_dir: str) -> DataFrame:
    """(file, ln, line) of all documents."""
    from ..sources import lines as L

    return L.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


LINES_SQL = "t AS (SELECT doc_id AS file, CAST(k - 1 AS INTEGER) AS ln, s[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(k))"


def points(spark, sf_dir: str) -> DataFrame:
    """(k0, e0, w) from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("k0"), F.col("value").alias("e0"), F.lit(1.0).alias("w"))


def spectra(spark, sf_dir: str) -> DataFrame:
    """(spectrum, p, e, v) from embeddings; e in steps of a hundredth."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum"), F.posexplode("embedding").alias("p", "x"))
    return e.select("spectrum", "p", (F.col("p") / 100 - 0.315).alias("e"), F.col("x").cast("double").alias("v"))


SPECTRA_SQL = "s AS (SELECT vec_id AS spectrum, CAST(k - 1 AS INTEGER) AS p, (k - 1) / 100 - 0.315 AS e, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(k))"
