"""Scans over chunks against windows over whole groups, and line numbers from splits against whole texts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources import calculation as C
from tessera.sources import lines as L


def rows(spark, n=400):
    rng = random.Random(8)
    made = [(f"f{k % 3}", ln, rng.choice([None, None, 1, 5, -2])) for k in range(3) for ln in sorted(rng.sample(range(3 * n), n))]
    return spark.createDataFrame(made, "file string, ln long, x int")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_scans_equal_windows(spark, size):
    df = rows(spark)
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("file", "ln", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.last("x", ignorenulls=True).over(w).alias("last")).collect()
    got = scan.running_last(scan.running_sum(df, ["file"], "ln", F.col("x"), "s", size), ["file"], "ln", F.col("x"), "last", size)
    assert got.columns == ["file", "ln", "x", "s", "last"]
    assert sorted((r.file, r.ln, r.s, r["last"]) for r in got.collect()) == sorted((r.file, r.ln, r.s, r["last"]) for r in want)
    before = scan.running_sum(df, ["file"], "ln", F.col("x"), "s", size, inclusive=False).collect()
    own = {(r.file, r.ln): r.s for r in want}
    assert all(r.s == own[r.file, r.ln] - (r.x or 0) for r in before)


def test_line_moves_equal_windows(spark):
    df = rows(spark).withColumn("line", F.coalesce(F.col("x").cast("string"), F.lit("")))
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("x") == 5
    want = df.select("file", "ln", F.sum(F.when(is_start, 1).otherwise(0)).over(w).alias("record"), F.row_number().over(Window.partitionBy("file").orderBy("ln")).alias("nth"))
    got = L.nth(L.numbered(df, is_start, size=10), size=10).select("file", "ln", "record", "nth")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_largest_group_is_a_chunk(spark):
    """The windows over rows are dealt by file and chunk; only those over chunks are dealt by file."""
    plan = L.carried(rows(spark), F.col("x"), "y", size=10)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.split("\n") if "Window" in line and "_x" in line]
    assert over_rows and all("_chunk" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in over_rows)


def test_path_length(spark):
    pts = [("a", k, float(k % 5), float(k * k % 7), 0.5 * k) for k in range(60)] + [("b", 0, 1.0, 2.0, 3.0)]
    got = {(r.file, r.kidx): r.dist for r in C.path_length(spark.createDataFrame(pts, "file string, kidx int, x double, y double, z double"), size=8).collect()}
    total = 0.0
    for k in range(60):
        if k:
            total += sum((pts[k][c] - pts[k - 1][c]) ** 2 for c in (2, 3, 4)) ** 0.5
        assert got["a", k] == pytest.approx(total, abs=1e-9)
    assert got["b", 0] == 0


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lines_of_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    (tmp_path / "big.txt").write_bytes(b"\n".join(b"%d %s" % (k, b"x" * rng.randint(0, 40)) + rng.choice([b"", b"\r"]) for k in range(900)) + b"\n\n\nend")
    (tmp_path / "small.txt").write_text("one\n\nthree\n")
    (tmp_path / "empty.txt").write_text("")
    assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() >= 3
    got = L.file_lines(spark, str(tmp_path))
    whole = L.text_lines(spark, str(tmp_path)).collect()
    last = {}
    for r in whole:
        last[r.file] = max(last.get(r.file, -1), r.ln)
    want = [(r.file, r.ln, r.line) for r in whole if r.line or r.ln < last[r.file]]  # without the piece after a final line end
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_readers_on_splits(spark, tmp_path, small_splits):
    """A cube and a hopping table of several splits give what their whole texts give."""
    rng = random.Random(2)
    cube = "c\nc\n1 0 0 0\n9 1 0 0\n8 0 1 0\n7 0 0 1\n6 6.0 0 0 0\n" + "\n".join(" ".join(f"{rng.random():.10E}" for _ in range(6)) for _ in range(84)) + "\n"
    hr = "written\n2\n40\n" + "\n".join(" ".join(["1"] * 15) for _ in range(2)) + "\n" + " ".join(["2"] * 10) + "\n"
    hr += "".join(f"{r} 0 0 {m} {n} {rng.random():.8f} {rng.random():.8f}\n" for r in range(40) for n in (1, 2) for m in (1, 2))
    for name, text in (("a.cube", cube), ("a_hr.dat", hr)):
        (tmp_path / name).write_text(text)
    assert spark.read.text(str(tmp_path / "a.cube")).rdd.getNumPartitions() >= 2
    for read, name in ((C.cubes, "a.cube"), (C.hopping_tables, "a_hr.dat")):
        for got, want in zip(read(L.file_lines(spark, str(tmp_path / name))), read(L.text_lines(spark, str(tmp_path / name))), strict=True):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_segment_without_labels_is_an_error(spark, tmp_path):
    head = "1 0 0.0\n" + " ".join(["1.0"] * 9) + "\n1\n"
    for name, labels in (("good", "G X"), ("bad", "G")):
        (tmp_path / name).write_text(f"{head}2 0 0 0 0.5 0 0 {labels}\n1 0 0 0\n0.1\n1 0.5 0 0\n0.2\n")
    assert [r.label for r in C.band_path(L.text_lines(spark, str(tmp_path / "good")))[1].orderBy("ord").collect()] == ["G", "X"]
    with pytest.raises(Exception, match="without two labels"):
        C.band_path(L.text_lines(spark, str(tmp_path / "bad")))[1].collect()


def test_totals_of_two_runs(spark):
    made = [(f"/d/{run}/DOS/{name}", "0.1 1 2") for run in ("r1", "r2") for name in ("x.DOS.T", "atom1/x.s1")]
    assert C.dos_rows(spark.createDataFrame(made, "file string, line string")).count() == 4
    with pytest.raises(Exception, match="several totals"):
        C.dos_rows(spark.createDataFrame([*made, ("/d/r1/DOS/y.DOS.T", "0 1 2")], "file string, line string")).collect()
