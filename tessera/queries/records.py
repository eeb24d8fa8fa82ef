"""Line tables, headers, unions, windows, voxels and orbital joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mesh, scan, voxel
from ..plans import scratch
from ..sources import calculation as C
from ..sources import headers
from ..sources import lines as L
from . import bindings as B


def last_number(spark, d):
    """The last number on a file's lines."""
    return L.last_value(B.lines(spark, d), F.regexp_extract("line", r"(\d+)", 1).try_cast("bigint"), "value")


def marked_block(spark, d):
    """Lines strictly between the last line with `tion` and the last line that ends in a stop."""
    got = L.block(B.lines(spark, d), F.contains(F.col("line"), F.lit("tion")), F.endswith(F.col("line"), F.lit(".")))
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("ln").alias("first"), F.max("ln").alias("last"))


def carried_marker(spark, d):
    """For each line, the number of the latest short line up to it."""
    rows = L.carried(B.lines(spark, d), F.when(F.length("line") < 40, F.col("ln")), "mark")
    return rows.groupBy("file").agg(F.sum(F.col("mark").cast("long")).alias("total"), F.count("mark").alias("n"))


def records(spark, d):
    """Records that start at lines whose first letter is upper-case A to M: number of lines and of characters."""
    rows = L.numbered(B.lines(spark, d), F.col("line").rlike("^[A-M]"))
    return rows.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line").cast("long")).alias("chars"))


def first_lines(spark, d):
    """The first three lines of each file, by length."""
    return L.nth(B.lines(spark, d)).where("nth <= 3").select("file", "nth", F.length("line").alias("chars"))


def stopped_lines(spark, d):
    """The lines from two below the last line with `and` up to the first short one."""
    got = L.after_until(B.lines(spark, d), F.contains(F.col("line"), F.lit("and")), 2, F.length("line") < 60)
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("ln").alias("first"))


def header_modules(spark, d):
    e = B.table(spark, d, "events")
    prefix = F.when(F.col("event_id") % 3 == 0, F.lit("Ext. VI 1>")).otherwise(F.lit(""))
    header = e.select(F.col("user_id").alias("file"), F.concat(prefix, F.col("event_type"), F.lit(">k"), F.col("event_id").cast("string")).alias("key"), F.get_json_object("props", "$.k").alias("value"))
    return headers.modules(header)


def nested_headers(spark, d):
    out = headers.nested(header_modules(spark, d).where("not single"))
    return out.select("file", F.size("header").alias("modules"), F.aggregate(F.transform(F.map_values("header"), lambda m: F.size(m)), F.lit(0), lambda s, x: s + x).alias("keys"))


def embedded_tables(spark, d):
    """Orders of a customer as a tab table with a header line, parsed back."""
    o = B.table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    row = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    text = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]), "\n").alias("t"))
    return headers.embedded(text.select(F.col("o_custkey").alias("file"), F.lit("ORDERS").alias("key"), F.concat(F.lit("key\tstatus\tpriority\n"), "t").alias("value")))


def preferred_source(spark, d):
    o = B.table(spark, d, "orders").select(F.concat(F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit("."), F.substring("o_orderpriority", 1, 1)).alias("file"))
    out = L.ranked_sources(o, {"1": 0, "2": 1, "3": 2}, F.split("file", "/")[0], F.element_at(F.split("file", r"\."), -1))
    return out.select("system", F.element_at(F.split("file", r"\."), -1).alias("kind"))


def best_order(spark, d):
    """Per customer, the order of the highest priority; ties by key."""
    o = B.table(spark, d, "orders")
    return mesh.best_by(o.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])


def path_length(spark, d):
    """Cumulative distance along a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = B.table(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    o = o.withColumn("step", F.coalesce(F.abs(F.col("p") - F.lag("p").over(w)), F.lit(0).cast("decimal(19,2)")))
    return o.select("o_custkey", "o_orderkey", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("dist"))


def tick_numbers(spark, d):
    """Running sum of segment sizes less one."""
    li = B.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("n"))
    return scan.running_sum(li, ["l_orderkey"], "l_linenumber", F.col("n"), "upto", size=4).select("l_orderkey", "l_linenumber", (F.col("upto") - 1).alias("tick"))


def labelled_union(spark, d):
    """Events by type as separate tables, put together again with a label."""
    e = B.table(spark, d, "events")
    parts = [e.where(F.col("event_type") == t).select("event_id", "value", F.lit(t).alias("kind")) for t in ("click", "view", "purchase", "scroll", "login", "search", "signup", "logout")]
    rest = e.where(~F.col("event_type").isin("click", "view", "purchase", "scroll", "login", "search", "signup", "logout")).select("event_id", "value", F.col("event_type").alias("kind"))
    for p in parts:
        rest = rest.unionByName(p)
    return rest


def extents(spark, d):
    return mesh.extents(B.table(spark, d, "events"), ["event_type"], "value", "user_id").withColumnRenamed("distinct", "users")


def _voxels(spark, d):
    o = B.table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    keys = [F.col("o_orderstatus").alias("cube_id"), (F.col("o_custkey") % 8).cast("int").alias("i"), (F.col("o_orderkey") % 8).cast("int").alias("j"), F.month("o_orderdate").alias("k")]
    return o.groupBy(*keys).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))


def voxel_difference(spark, d):
    v = _voxels(spark, d)
    out = voxel.difference(v.where("cube_id = 'F'"), v.where("cube_id = 'O'"))
    return out.withColumn("value", F.col("value").cast("double"))


def block_difference(spark, d):
    """The same cubes as stored blocks in buckets, a table for each cube."""
    v, sides = _voxels(spark, d), []
    for cube in ("F", "O"):
        folder = scratch.new_folder(spark, f"voxels-{cube}")
        name = "voxels_" + folder.rsplit("-", 1)[1]
        voxel.save_blocks(voxel.blocks(v.where(F.col("cube_id") == cube), side=4), name, folder, 16)
        sides.append(spark.table(name))
    return voxel.unblocked(voxel.block_difference(*sides), side=4).withColumn("value", F.col("value").cast("double"))


def cube_compatible(spark, d):
    """Whether two cubes span the same grid; the axes follow from the cubes' extents."""
    o = B.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cube_id")).agg((F.max(F.col("o_custkey") % 8) + 1).cast("int").alias("n1"), (F.max(F.col("o_orderkey") % 8) + 1).cast("int").alias("n2"), F.count_distinct(F.col("o_orderdate").cast("date")).cast("int").alias("n3"))
    meta = o.withColumns({c: F.lit(1.0 if c in ("a1x", "a2y", "a3z") else 0.0) for c in voxel.META if c[0] != "n"})
    pairs = spark.createDataFrame([("F", "O"), ("F", "P"), ("O", "O"), ("F", "X")], "first string, second string")
    return voxel.compatible(meta, pairs).select("first", "second", F.array_join("differs", ",").alias("differs"), "ok")


def orbital_columns(spark, d):
    """Suppliers as atoms, nations as elements with shells, regions as files."""
    n = B.table(spark, d, "nation")
    atoms = B.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("file"), F.col("s_suppkey").alias("ord"), F.col("n_name").alias("element"))
    shells = n.select(F.col("n_regionkey").alias("file"), F.col("n_name").alias("label"), (1 + F.col("n_nationkey") % 2).alias("n_s"), (F.col("n_nationkey") % 3).alias("n_p"), (F.col("n_nationkey") % 2).alias("n_d"))
    return C.orbital_columns(atoms, shells)


def basis_counts(spark, d):
    """Shell counts read from strings such as `B6.0-s1p2d0`, one for each part."""
    p = B.table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 11 == 0, F.lit("none")).otherwise(F.concat(F.lit("B6.0-s"), F.col("p_size") % 4, F.lit("p"), F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("d"), F.col("p_size") % 3)).otherwise(F.lit(""))))
    return p.select("p_partkey", text.alias("basis")).withColumns({f"n_{s}": C.shell_count(F.col("basis"), s) for s in "spd"})


def selected_weights(spark, d):
    """Weights of one element and one atom, summed for each row."""
    li = B.table(spark, d, "lineitem").select(F.lit("f").alias("file"), F.col("l_orderkey").alias("row_id"), (F.col("l_orderkey") % 100).cast("double").alias("kpath"), (F.col("l_orderkey") % 7).cast("double").alias("energy"), F.col("l_returnflag").alias("element"), F.col("l_linenumber").alias("atom"), F.col("l_quantity").alias("weight"))
    return C.selected_weight(li, element="R").select("row_id", "kpath", "energy", "w").unionByName(C.selected_weight(li, atom=2).select(-F.col("row_id").alias("row_id"), "kpath", "energy", "w").toDF("row_id", "kpath", "energy", "w"))


def spins_by_number(spark, d):
    """Orders as positions, line items as spin weights, met by number; orders without a fourth item keep nulls."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), "o_totalprice")
    li = B.table(spark, d, "lineitem").where("l_linenumber = 4").groupBy(F.col("l_orderkey").alias("ord")).agg(F.sum("l_quantity").alias("up"))
    return o.join(li, "ord", "left")


QUERIES = {
    "w04_s08_last_number": last_number, "w03_marked_block": marked_block, "w05_s19_carried_marker": carried_marker, "w08_s16_records": records, "o05_s09_first_lines": first_lines, "s13_stopped_lines": stopped_lines,
    "p16_header_modules": header_modules, "s04_nested_headers": nested_headers, "p17_embedded_tables": embedded_tables, "s21_preferred_source": preferred_source, "j07_w07_best_order": best_order, "w01_path_length": path_length,
    "w02_tick_numbers": tick_numbers, "u01_labelled_union": labelled_union, "a13_extents": extents, "j01_voxel_difference": voxel_difference, "j01_block_difference": block_difference, "j02_cube_compatible": cube_compatible, "j05_orbital_columns": orbital_columns,
    "s12_basis_counts": basis_counts, "p22_a05_selected_weights": selected_weights, "j06_spins_by_number": spins_by_number,
}

_T = f"WITH {B.LINES_SQL}"
SQL = {
    "w04_s08_last_number": f"{_T} SELECT file, arg_max(CAST(regexp_extract(line, '(\\d+)', 1) AS BIGINT), ln) AS value FROM t WHERE try_cast(regexp_extract(line, '(\\d+)', 1) AS BIGINT) IS NOT NULL GROUP BY file",
    "w03_marked_block": f"{_T}, m AS (SELECT file, max(CASE WHEN contains(line, 'tion') THEN ln END) AS s, max(CASE WHEN suffix(line, '.') THEN ln END) AS e FROM t GROUP BY file) SELECT file, count(*) AS n, min(ln) AS first, max(ln) AS last FROM t JOIN m USING (file) WHERE ln > s AND ln < e AND trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#') GROUP BY file",
    "w05_s19_carried_marker": f"{_T}, m AS (SELECT file, last_value(CASE WHEN length(line) < 40 THEN ln END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING) AS mark FROM t) SELECT file, CAST(sum(mark) AS BIGINT) AS total, count(mark) AS n FROM m GROUP BY file",
    "w08_s16_records": f"{_T}, r AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING) AS INTEGER) AS record FROM t) SELECT file, record, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM r GROUP BY file, record",
    "o05_s09_first_lines": f"{_T} SELECT file, ln + 1 AS nth, CAST(length(line) AS INTEGER) AS chars FROM t WHERE ln < 3",
    "s13_stopped_lines": f"{_T}, a AS (SELECT file, max(ln) + 2 AS f FROM t WHERE contains(line, 'and') GROUP BY file), b AS (SELECT t.* FROM t JOIN a USING (file) WHERE ln >= f), s AS (SELECT file, min(ln) AS stop FROM b WHERE length(line) < 60 GROUP BY file) SELECT file, count(*) AS n, min(ln) AS first FROM b LEFT JOIN s USING (file) WHERE stop IS NULL OR ln < stop GROUP BY file",
    "p16_header_modules": "SELECT user_id AS file, event_type AS module, 'k' || event_id AS key, json_extract_string(props, '$.k') AS value, count(*) OVER (PARTITION BY user_id, event_type) = 1 AS single FROM events",
    "s04_nested_headers": "WITH m AS (SELECT user_id AS file, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1) SELECT file, CAST(count(*) AS INTEGER) AS modules, CAST(sum(n) AS INTEGER) AS keys FROM m GROUP BY file",
    "p17_embedded_tables": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), c AS (SELECT * FROM o) SELECT o_custkey AS file, 'ORDERS' AS section, CAST(n AS INTEGER) AS row, u.column, u.value FROM c, LATERAL (SELECT 'key' AS column, CAST(o_orderkey AS VARCHAR) AS value UNION ALL SELECT 'status', o_orderstatus UNION ALL SELECT 'priority', o_orderpriority) u",
    "s21_preferred_source": "SELECT CAST(o_custkey AS VARCHAR) AS system, min(substr(o_orderpriority, 1, 1)) AS kind FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') GROUP BY o_custkey",
    "j07_w07_best_order": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1",
    "w01_path_length": "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, coalesce(abs(CAST(o_totalprice AS DECIMAL(18,2)) - lag(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), 0) AS step FROM orders) SELECT o_custkey, o_orderkey, CAST(sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS dist FROM s",
    "w02_tick_numbers": "WITH n AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS tick FROM n",
    "u01_labelled_union": "SELECT event_id, value, event_type AS kind FROM events",
    "a13_extents": "SELECT event_type, min(value) AS low, max(value) AS high, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "j01_voxel_difference": "WITH v AS (SELECT o_orderstatus AS s, CAST(o_custkey % 8 AS INTEGER) AS i, CAST(o_orderkey % 8 AS INTEGER) AS j, CAST(month(o_orderdate) AS INTEGER) AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY ALL) SELECT a.i, a.j, a.k, CAST(a.value - b.value AS DOUBLE) AS value FROM v a JOIN v b ON a.i = b.i AND a.j = b.j AND a.k = b.k WHERE a.s = 'F' AND b.s = 'O'",
    "j02_cube_compatible": """WITH m AS (SELECT o_orderstatus AS c, CAST(max(o_custkey % 8) + 1 AS INTEGER) AS n1, CAST(max(o_orderkey % 8) + 1 AS INTEGER) AS n2, count(DISTINCT CAST(o_orderdate AS DATE)) AS n3 FROM orders GROUP BY ALL), p(first, second) AS (VALUES ('F', 'O'), ('F', 'P'), ('O', 'O'), ('F', 'X')),
j AS (SELECT first, second, b.c IS NULL AS gone, concat_ws(',', CASE WHEN a.n1 <> b.n1 THEN 'n1' END, CASE WHEN a.n2 <> b.n2 THEN 'n2' END, CASE WHEN a.n3 <> b.n3 THEN 'n3' END) AS d FROM p LEFT JOIN m a ON a.c = first LEFT JOIN m b ON b.c = second)
SELECT first, second, CASE WHEN gone THEN 'n1,n2,n3,ox,oy,oz,a1x,a1y,a1z,a2x,a2y,a2z,a3x,a3y,a3z' ELSE d END AS differs, NOT gone AND d = '' AS ok FROM j""",
    "j05_orbital_columns": """WITH a AS (SELECT n_regionkey AS file, s_suppkey AS ord, n_name AS element, 1 + n_nationkey % 2 AS n_s, n_nationkey % 3 AS n_p, n_nationkey % 2 AS n_d FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o(shell, k, orb) AS (VALUES (0, 0, 's'), (1, 0, 'px'), (1, 1, 'py'), (1, 2, 'pz'), (2, 0, 'd3z^2-r^2'), (2, 1, 'dx^2-y^2'), (2, 2, 'dxy'), (2, 3, 'dxz'), (2, 4, 'dyz')),
e AS (SELECT file, ord, element, shell, m, k, m || orb AS orbital, dense_rank() OVER (PARTITION BY file ORDER BY ord) - 1 AS atom FROM a, o, range(3) AS u(m) WHERE m < CASE shell WHEN 0 THEN n_s WHEN 1 THEN n_p ELSE n_d END)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY ord, shell, m, k) - 1 AS INTEGER) AS position, CAST(atom AS INTEGER) AS atom, element, orbital, atom || '-' || element || '-' || orbital AS name FROM e""",
    "s12_basis_counts": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'none' ELSE 'B6.0-s' || p_size % 4 || 'p' || p_partkey % 3 || CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_size % 3 ELSE '' END END AS basis, CASE WHEN p_partkey % 11 <> 0 THEN p_size % 4 END AS n_s, CAST(CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 3 END AS INTEGER) AS n_p, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size % 3 ELSE 0 END END AS n_d FROM part",
    "p22_a05_selected_weights": "SELECT l_orderkey AS row_id, CAST(l_orderkey % 100 AS DOUBLE) AS kpath, CAST(l_orderkey % 7 AS DOUBLE) AS energy, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey UNION ALL SELECT -l_orderkey, CAST(l_orderkey % 100 AS DOUBLE), CAST(l_orderkey % 7 AS DOUBLE), sum(l_quantity) FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey",
    "j06_spins_by_number": "SELECT o_orderkey AS ord, o_totalprice, up FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS up FROM lineitem WHERE l_linenumber = 4 GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
}
SQL["j01_block_difference"] = SQL["j01_voxel_difference"]
