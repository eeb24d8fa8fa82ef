"""Line tables made of the given tables, and what their readers spend on each line."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.queries import QUERIES, files
from tessera.sources import calculation as C
from tessera.sources import lines as L


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_made_lines_are_those_of_a_text(spark):
    orders = spark.sql("select * from values (1, array(named_struct('p', 5), named_struct('p', 7))), (2, array(named_struct('p', 9))) t(file, it)")
    made = files._text(orders, F.when(F.col("file") == 1, "odd"), "head", lambda x, i: files._line(i, x["p"]), files._line(F.size("it"), F.col("it")[0]["p"]), "", lambda x, i: [files._line(x["p"]), F.lit("-")], "end")
    got = {}
    for r in made.collect():
        got.setdefault(r.file, {})[r.ln] = r.line
    want = {1: "odd\nhead\n1 5\n2 7\n2 5\n\n5\n-\n7\n-\nend", 2: "head\n1 9\n1 9\n\n9\n-\nend"}
    assert {f: [ls[k] for k in range(len(ls))] for f, ls in got.items()} == {f: t.split("\n") for f, t in want.items()}


@pytest.mark.parametrize("name", ["s19_log_spreads", "w02_band_ticks", "s18_cube_voxels", "s17_unfolding"])
def test_lines_are_not_glued_and_cut_again(spark, sf, name):
    assert not re.search("array_join|lambdafunction", plan_of(QUERIES[name](spark, sf)))


def test_words_of_odd_lines(spark):
    odd = ["", "  ", "a", " a b ", "a  b", "a\tb", "a \t b", "\ta b", "a\t", "a\x0bb\x0cc", "a\rb", "a\nb", "é ü x", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, line string").withColumn("t", L.tokens(F.col("line"))).orderBy("k").collect()
    assert [r.t for r in rows] == [None if t is None else [] if not t.strip(" ") else re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")) for t in odd]


def test_plain_lines_are_cut_without_a_pattern(spark):
    plan = plan_of(spark.range(1).select(F.concat(F.lit("a "), F.col("id").cast("string")).alias("line")).select(L.tokens(F.col("line")).alias("t")))
    assert ",  , -1)" in plan.replace("\\", "")  # a cut at one space


@pytest.mark.parametrize(("name", "text"), [("s19_log_disentangle", "regexp_extract(line"), ("s07_lattice_vectors", "regexp_extract_all(")])
def test_patterns_are_matched_once(spark, sf, name, text):
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count(text) == {"s19_log_disentangle": 2, "s07_lattice_vectors": 1}[name]  # tolerances and sums; vectors


def test_missing_shells_are_not_cast(spark):
    assert "null else try_cast(regexp_extract" in plan_of(spark.createDataFrame([("Fe6.0-s3p2",)], "basis string").select(C.shell_count(F.col("basis"), "d")))
    rows = spark.createDataFrame([("Fe6.0-s3p2",), ("Fe6.0",)], "basis string").select(*[C.shell_count(F.col("basis"), s) for s in "spd"]).collect()
    assert list(map(tuple, rows)) == [(3, 2, 0), (None, None, None)]


def test_band_points_take_four_rounds_of_windows(spark, sf):
    assert plan_of(QUERIES["s16_w01_band_points"](spark, sf)).count("Window [") == 4


@pytest.mark.parametrize("name", ["p14_image_metadata", "p14_grid_metadata", "s04_tab_pairs"])
def test_ends_and_keys_are_one_round_of_windows(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("Window [") == 1 and "transform(" not in plan
