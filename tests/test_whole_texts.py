"""Readers of texts that were one row each: the rows of the general route, with the lines read once and met with nothing."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh
from tessera.queries import QUERIES, SQL
from tessera.sources import calculation as C
from tessera.sources import headers, instrument
from tessera.sources import lines as L


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines_of(spark, texts):
    return L.split_lines(spark.createDataFrame(texts, "file string, text string"), "file", "text")


def same(got, want):
    assert got.columns == want.columns
    rows = sorted(map(str, got.collect()))
    assert rows and rows == sorted(map(str, want.collect()))


def test_pixels_are_turned_by_their_own_heads(spark, sf):
    def image(nx, ny, way):
        said = f":SCAN_DIR:\n{way}\n" if way else ""
        head = f":SCAN_PIXELS:\n {nx} {ny}\n{said}:DATA_INFO:\n\tChannel\tName\tUnit\n\t14\tZ\tm\n:SCANIT_END:\n\n\n"
        return head, head.encode() + b"\x1a\x04" + b"".join(bytes([63, 128 + k, 0, 0]) for k in range(2 * nx * ny))

    made = [(f"f{k}", *image(2 + k % 3, 1 + k % 4, way)) for k, way in enumerate(["up", "down", "", " up "] * 3)]
    files = spark.createDataFrame([(f, c) for f, _, c in made], "file string, content binary")
    got = instrument.decoded_pixels(files, sized=True)
    meta = headers.image_metadata(headers.colon_blocks(lines_of(spark, [(f, h) for f, h, _ in made])))
    same(mesh.flipped(got, F.col("ny"), F.col("nx"), scan_up=F.col("up")).drop("nx", "ny", "up"), mesh.flipped_scans(instrument.decoded_pixels(files), meta))
    assert "Join" not in plan_of(QUERIES["g08_flipped_scans"](spark, sf))


def test_positions_of_whole_texts(spark, sf):
    block = "<Atoms.SpeciesAndCoordinates\n1 Fe 1 2 3 4 5\n2 C 2 3 4 5 6\n x Si 1 1 1 7 8\nAtoms.SpeciesAndCoordinates>\n"
    final = "  Fractional coordinates of the final structure\n***\n\n\n 1 Co 0.5 0.25 0.75\n 2 C 0 0 0\n\n 3 Xx 1 1 1\n"
    texts = [("frac", block), ("ang", "Atoms.SpeciesAndCoordinates.Unit Ang\n" + block), ("au", "Atoms.SpeciesAndCoordinates.Unit AU\n" + block), ("final", block + final), ("only", final), ("two", block + block + final + final), ("cut", final[:-20]), ("none", "a\n\nb")]
    lines = lines_of(spark, texts)
    cells = spark.createDataFrame([(f, a, 2.0 * (a == 1), 3.0 * (a == 2), 4.0 * (a == 3)) for f in ("ang", "frac") for a in (1, 2, 3)], "file string, axis int, x double, y double, z double")
    same(C.positions(lines, cells, whole=True), C.positions(lines, cells))
    assert plan_of(QUERIES["j06_j07_positions"](spark, sf)).count("Join") == 1  # the cells


LOG = " *--- DISENTANGLE ---*\n Convergence tolerence : 1.0E-10\n 1 2.0 2.0 0.5 0.1 <-- DIS\n x 2 <-- DIS\n *--- WANNIERISE ---*\n Convergence tolerence : 1.0E-8\n Initial State\n WF centre and spread 1 ( 0, 0, 0 ) 9.5\n O_D= 0.5 <-- DLTA\n Cycle: 1\n WF centre and spread 1 ( 0, 0, 0 ) 8.5\n O_D= 0.25 <-- DLTA\n Cycle: 2\n"


def test_logs_of_whole_texts(spark, sf):
    lines = lines_of(spark, [("a", LOG), ("b", LOG + LOG), ("c", LOG[60:]), ("d", "O_D= 1 <-- DLTA")])
    for got, want in zip(C.convergence_logs(lines, whole=True), C.convergence_logs(lines), strict=True):
        same(got, want)
    assert "Join" not in plan_of(QUERIES["s19_log_spreads"](spark, sf))


def band_texts():
    head = "2 0 0.25\n1.0 0 0 0 2.0 0 0.5 0 1.0\n2\n2 0 0 0 0.5 0 0 G X\n2 0.5 0 0 1 1 0 X M\n"
    body = "2 0 0 0\n0.1 0.2\n2 0.5 0 0\n0.3\n0.4\n\n2 bad 1 0\n0.5 0.6 0.7\n2 1 1 0\n"
    return [("a", head + body), ("b", head), ("c", head + "0.1 0.2\n" + body + body), ("d", "1 0 0\n")]


def test_ticks_of_whole_texts(spark, sf):
    lines = lines_of(spark, band_texts())
    same(C.band_path(lines, whole=True)[1], C.band_path(lines)[1])
    assert "Join" not in plan_of(QUERIES["w02_band_ticks"](spark, sf))


def test_band_points_of_whole_texts(spark, sf):
    lines = lines_of(spark, band_texts())
    same(C.band_path(lines, whole=True)[0], C.band_path(lines)[0])
    assert "Join" not in plan_of(QUERIES["s16_w01_band_points"](spark, sf))


def test_disentangle_without_scans_of_all_lines(spark, sf):
    assert plan_of(QUERIES["s19_log_disentangle"](spark, sf)).count("Join") == 2  # settings and sums of a file, by the query itself


def test_cubes_of_whole_texts(spark, sf):
    cube = "c\nc\n1 0 0 0\n2 1 0 0\n2 0 1 0\n3 0 0 1\n6 6.0 0 0 0\n1 2 3 4 5\n6 7\n\n8 9 10 11 12\n"
    lines = lines_of(spark, [("a", cube), ("b", cube.replace("2 0 1 0\n", "\n")), ("c", cube[:30])])
    for got, want in zip(C.cubes(lines, whole=True), C.cubes(lines), strict=True):
        same(got, want)
    assert "Join" not in plan_of(QUERIES["s18_cube_voxels"](spark, sf))


def test_species_of_whole_texts(spark, sf):
    block = "<Definition.of.Atomic.Species\n C C6.0-s2p1 C_PBE\n# x\n Qq Q1-s1 Q\n Fe1 Fe6.0 Fe_PBE\n one\nDefinition.of.Atomic.Species>\n"
    lines = lines_of(spark, [("a", block), ("b", block + block), ("c", block[:40]), ("d", "x")])
    same(C.species(lines, whole=True), C.species(lines))
    assert "Join" not in plan_of(QUERIES["s11_species"](spark, sf))


def test_colon_blocks_of_whole_texts(spark, sf):
    lines = lines_of(spark, [("a", "x\n:A:\n1\n\n 2\n:B C:  \n::\n:D:\n:SCANIT_END:\n:E:\n5\n:SCANIT_END:"), ("b", ":A:\n1"), ("c", ":SCANIT_END:")])
    same(headers.colon_blocks(lines, whole=True), headers.colon_blocks(lines))
    assert "Join" not in plan_of(QUERIES["p14_image_metadata"](spark, sf))


def vector_texts():
    new = "Reciprocal-Space Vectors (Ang^-1)\n b_1 1 2 3\n b_2 4 5 6\n b_3 7 8 9\n b_1 0 0 0\n"
    old = "".join(f"Reciprocal vector b{a} (1/Ang): {a}.5 -1E-2 3D0\n" for a in (1, 2, 3))
    return [("new", new), ("old", old), ("both", old + new), ("again", new + old + "Reciprocal vector b1 (1/Ang): 1\n"), ("heads", "Reciprocal-Space Vectors\nReciprocal-Space Vectors\n" + new), ("lone", new + "\n b_2 9 9 9\n")]


def test_vectors_of_whole_texts(spark, sf):
    lines = lines_of(spark, vector_texts())
    same(C.reciprocal_vectors(lines, whole=True), C.reciprocal_vectors(lines))
    assert "Join" not in plan_of(QUERIES["s10_reciprocal_vectors"](spark, sf))


def test_lattice_vectors_are_looked_up_once(spark, sf):
    lines = lines_of(spark, vector_texts())
    for whole in (False, True):
        same(C.lattice_vectors(lines, whole=whole), C.reciprocal_vectors(lines))
        with pytest.raises(Exception, match="no three reciprocal vectors in bad"):
            C.lattice_vectors(lines_of(spark, [*vector_texts(), ("bad", "x")]), whole=whole).collect()
    assert plan_of(QUERIES["s07_lattice_vectors"](spark, sf)).count("Join") == 1  # the files, of which each is asked for


def test_hopping_of_whole_texts(spark, sf):
    rows = "".join(f"{r} 0 0 {m} {n} {r + m / 8} {n / 4}\n" for r in (3, -1, 0, 7) for n in (1, 2) for m in (1, 2))
    texts = [("a", "written\n2\n4\n1 2 3\n4\n" + rows), ("b", "2\n\n4\n1 2 3 4\n" + rows), ("short", "1 2\n2\n4\n1 2 3 4\n" + rows + "1 2 3\n" + "x 0 0 1 1 0 0\n"), ("few", "2\n5\n1 2 3 x 4\n" + rows), ("none", "2\n")]
    for got, want in zip(C.hopping_tables(lines_of(spark, texts), whole=True), C.hopping_tables(lines_of(spark, texts)), strict=True):
        same(got, want)
    assert "Join" not in plan_of(QUERIES["s05_hopping_files"](spark, sf))


def test_weights_do_not_meet_columns_by_position(spark, sf):
    columns = spark.createDataFrame([("a", 0, 0, "C", "0s"), ("a", 1, 1, "Fe", "0s"), ("b", 0, 0, "C", "0s")], "file string, position int, atom int, element string, orbital string")
    lines = lines_of(spark, [("a", "1 2 3 4\n\n5 6 7 x\n"), ("b", "1 2 3"), ("without", "1 2 3")])
    got = {(r.file, r.row_id, r.position): (r.element, r.weight) for r in C.unfolding(lines, columns).collect()}
    assert got == {("a", 0, 0): ("C", 3.0), ("a", 0, 1): ("Fe", 4.0), ("a", 2, 0): ("C", 7.0), ("a", 2, 1): ("Fe", None), ("b", 0, 0): ("C", 3.0)}
    with pytest.raises(Exception, match="unexpected number of columns"):
        C.unfolding(lines_of(spark, [("a", "1 2 3")]), columns).collect()
    assert plan_of(QUERIES["s17_unfolding"](spark, sf)).count("Join") == 1


def test_columns_of_all_files_are_sent_to_the_lines(spark, sf):
    shared = spark.createDataFrame([(0, 0, "C", "0s"), (1, 1, "Fe", "0s")], "position int, atom int, element string, orbital string")
    lines = lines_of(spark, [("a", "1 2 3 4\n\n5 6 7 x\n"), ("b", "1  2\t3 4D1"), (None, "1 2 3 4")])
    got = C.unfolding(lines, shared)
    same(got.where("file is not null"), C.unfolding(lines, shared.crossJoin(lines.select("file").distinct())))
    assert {(r.row_id, r.position, r.weight) for r in got.where("file is null").collect()} == {(0, 0, 3.0), (0, 1, 4.0)}
    with pytest.raises(Exception, match="unexpected number of columns"):
        C.unfolding(lines_of(spark, [("a", "1 2 3 4\n1 2 3")]), shared).collect()
    plan = QUERIES["s17_unfolding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1


def test_lines_meet_their_columns_before_they_are_cut(spark):
    columns = spark.createDataFrame([("a", 0, 0, "C", "0s")], "file string, position int, atom int, element string, orbital string")
    plan = plan_of(C.unfolding(lines_of(spark, [("a", "1 2 3")]), columns))
    assert plan.index(",  , -1)") < plan.index("Join")  # words are made above the meeting, not sorted for it


def test_weights_of_orders_without_a_key(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 1, 10, 3, 5.0), (1, 2, 20, 4, 6.0), (None, 1, 30, 5, 7.0), (None, 2, 40, 6, 8.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(f"SELECT file, row_id, position, weight FROM ({SQL['s17_unfolding']})").fetchall()
    got = QUERIES["s17_unfolding"](spark, str(tmp_path)).select("file", "row_id", "position", "weight").collect()
    assert len(want) == 12 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pairs_of_whole_texts(spark, sf):
    lines = lines_of(spark, [("a", 'x\nA="1"\nmore\n\nB=2=3\n:HEADER_END:\nC=4\n'), ("b", "A=1"), ("c", "A\t1\t\nmore\n[DATA]\nB\t2\n")])
    for read in (headers.equals_pairs, headers.tab_pairs):
        same(read(lines, whole=True), read(lines))
    assert "Join" not in plan_of(QUERIES["p14_grid_metadata"](spark, sf))


def test_blocks_of_whole_texts(spark, sf):
    final = "  Fractional coordinates of the final structure\n***\n\n\n 1 Co 0.5 0.25 0.75\n 2 C 0 0 0\n* 3 Xx 1 1 1\n"
    units = "<Atoms.UnitVectors\n# a\n1 2 3\n\n4 5 6\n7 8 9\n1 1 1\nAtoms.UnitVectors>\n"
    lines = lines_of(spark, [("a", final + units), ("b", units + final + final), ("c", units[:20]), ("d", "x")])
    for read in (C.final_positions, C.unit_cells):
        same(read(lines, whole=True), read(lines))
    assert "Join" not in plan_of(QUERIES["s13_final_positions"](spark, sf))
