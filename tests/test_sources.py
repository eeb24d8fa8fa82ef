"""Generated files with known contents through every reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hopping, mesh, voxel
from tessera.plans import jobs
from tessera.sources import calculation as C
from tessera.sources import headers, instrument, store
from tessera.sources import lines as L

IMAGE_HEAD = """:VERSION:
2
:SCAN_PIXELS:
       3       2
:SCAN_RANGE:
           1.000000E-7           2.000000E-7
:SCAN_OFFSET:
           0.5E-7   -0.25E-7
:SCAN_ANGLE:
            3.000E+1
:SCAN_DIR:
up
:BIAS:
            1.500E+0
:Z-CONTROLLER:
\tName\ton\tSetpoint
\tlog Current\t1\t1.000E-10 A
:DATA_INFO:
\tChannel\tName\tUnit
\t14\tZ\tm
\t0\tCurrent\tA
:Ext. VI 1>Mod>a:
7
:Mod>b:
8
:Solo>c:
9
:SCANIT_END:


"""


def image(values):
    return IMAGE_HEAD.encode() + b"\x1a\x04" + np.asarray(values, ">f4").tobytes()


@pytest.fixture
def images(tmp_path):
    v = np.arange(24, dtype=float)
    v[5] = np.nan
    (tmp_path / "full.sxm").write_bytes(image(v))
    (tmp_path / "cut.sxm").write_bytes(image(np.arange(20)))
    return str(tmp_path)


def test_scan_pixels(spark, images):
    px = instrument.scan_pixels(spark, images)
    full = {(r.channel, r.direction, r.row, r.col): r.value for r in px.where(F.col("file").endswith("full.sxm")).collect()}
    assert len(full) == 24
    assert full["Z", "fwd", 0, 0] == 0
    assert full["Z", "fwd", 1, 1] == 4
    assert np.isnan(full["Z", "fwd", 1, 2])
    assert full["Current", "bwd", 1, 2] == 23
    cut = px.where(F.col("file").endswith("cut.sxm"))
    assert cut.where("value is null").count() == 4
    turned = mesh.flipped(px.where(F.col("file").endswith("full.sxm")), 2, 3)
    at = {(r.channel, r.direction, r.row, r.col): r.value for r in turned.collect()}
    assert at["Z", "fwd", 1, 0] == 0
    assert at["Z", "bwd", 1, 2] == 6


def test_image_header(spark, images):
    head = headers.colon_blocks(instrument.image_header_lines(spark, images + "/full.sxm"))
    meta = headers.image_metadata(head).first()
    assert (meta.nx, meta.ny, meta.range_x, meta.centre_y, meta.angle, meta.direction, meta.bias) == (3, 2, 1e-7, -0.25e-7, 30.0, "up", 1.5)
    mods = {(r.module, r.key): (r.value, r.single) for r in headers.modules(head).collect()}
    assert mods["Mod", "a"] == ("7", False)
    assert mods["Mod", "b"] == ("8", False)
    assert mods["Solo", "c"] == ("9", True)
    cells = {(r.section, r.row, r.column): r.value for r in headers.embedded(head.where("key in ('DATA_INFO', 'Z-CONTROLLER')")).collect()}
    assert cells["DATA_INFO", 2, "Name"] == "Current"
    assert cells["Z-CONTROLLER", 1, "Setpoint"] == "1.000E-10 A"


def test_point_spectra(spark, tmp_path):
    text = "Experiment\tbias\t\r\nComment\tline one\nline two\t\r\nBias Spectroscopy>MultiLine Settings: a,b\t1,2;3,4\t\r\n\r\n[DATA]\r\nBias (V)\tCurrent (A)\r\n0.1\t1e-9\r\n\r\n0.2\toops\r\n0.3\t3e-9\r\n"
    (tmp_path / "p.dat").write_bytes(text.encode())
    lines = L.text_lines(spark, str(tmp_path))
    got = {(r.point, r.channel): r.value for r in instrument.point_spectra(lines).collect()}
    assert got == {(0, "Bias (V)"): 0.1, (0, "Current (A)"): 1e-9, (1, "Bias (V)"): 0.2, (1, "Current (A)"): None, (2, "Bias (V)"): 0.3, (2, "Current (A)"): 3e-9}
    head = {r.key: r.value for r in headers.tab_pairs(lines).collect()}
    assert head["Experiment"] == "bias"
    assert head["Bias Spectroscopy>MultiLine Settings: a,b"] == "1,2;3,4"


@pytest.mark.parametrize(("extra", "missing"), [(0, 0), (3, 0), (-5, 5)])
def test_grid_spectra(spark, tmp_path, extra, missing):
    head = 'Grid dim="2 x 3"\r\nPoints=4\r\nChannels=I;V\r\n# Parameters (4 byte)=3\r\nExperiment size (bytes)=32\r\nFixed parameters=s\r\nExperiment parameters=x;y\r\n:HEADER_END:\r\n'
    n = 6 * (3 + 8)
    (tmp_path / "g.3ds").write_bytes(head.encode() + np.arange(n + extra, dtype=">f4").tobytes())
    got = {(r.pixel, r.kind, r["name"]): r["values"] for r in instrument.grid_spectra(spark, str(tmp_path)).collect()}
    assert len(got) == 6 * 5
    assert got[1, "param", "x"] == [12.0]
    assert got[2, "channel", "V"] == [29.0, 30.0, 31.0, 32.0]
    assert sum(x is None for v in got.values() for x in v) == missing
    meta = headers.grid_metadata(headers.equals_pairs(instrument.image_header_lines(spark, str(tmp_path), b":HEADER_END:"))).first()
    assert (meta.nx, meta.ny, meta.points, meta.channels, meta.param_names) == (2, 3, 4, ["I", "V"], ["s", "x", "y"])


def hr_text(first=True, rows=None, nrpts=2):
    body = [f"{r} 0 0 {m} {n} {0.5 * r + m} {0.1 * n}" for r in range(2) for n in (1, 2) for m in (1, 2)]
    return ("written on 1Jan2020 at 10:00\n" if first else "") + f"2\n{nrpts}\n1 2\n" + "\n".join(body[:rows]) + "\n"


@pytest.mark.parametrize("first", [True, False])
def test_hopping_tables(spark, tmp_path, first):
    (tmp_path / "a_hr.dat").write_text(hr_text(first))
    header, table, bad = C.hopping_tables(L.text_lines(spark, str(tmp_path)))
    assert header.first()[1:] == (2, 2)
    assert bad.isEmpty()
    got = {(r.r1, r.m, r.n): (r.re, r.im, r.ndegen) for r in table.collect()}
    assert len(got) == 8
    assert got[1, 0, 1] == (1.5, 0.2, 2.0)
    assert hopping.complete_check(table, header).first().ok


def test_hopping_defects(spark, tmp_path):
    (tmp_path / "a_hr.dat").write_text(hr_text(rows=7))
    (tmp_path / "b_hr.dat").write_text(hr_text() + "1 0 0\n")
    header, table, bad = C.hopping_tables(L.text_lines(spark, str(tmp_path)))
    assert bad.count() == 1
    assert not any(r.ok for r in hopping.complete_check(table, header).where(F.col("system_id").endswith("a_hr.dat")).collect())


def test_joint_density_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a_hr.dat").write_text("1\n3\n1 1 1\n" + "".join(f"{r} 0 0 1 1 {v} 0\n" for r, v in ((-1, -1.0), (0, 0.2), (1, -1.0))))
    n, energies, eta = 4, [0.0, 1.0], 0.3
    got = jobs.joint_density_map(spark, str(tmp_path / "in"), n, energies, eta, (-1.0, 1.0), str(tmp_path / "store"))
    assert got.count() == 2 * 64
    k = np.arange(n) / n - 0.5
    band = np.repeat((0.2 - 2 * np.cos(2 * np.pi * k))[:, None], n, 1)
    for layer, e in enumerate(energies):
        a = eta / np.pi / ((e - band) ** 2 + eta**2)
        want = np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(a)) ** 2).real)
        want /= want.max()
        for r in got.where(F.col("layer") == layer).collect():
            assert np.isclose(r.v, want[r.i % n, r.j % n])
    meta = store.runs(spark, str(tmp_path / "store")).first()
    assert (meta.module_type, meta.nq, meta.energies, meta.normalize) == ("jdos", 4, energies, True)


OUT = """ Chemical Potential (Hartree) = -0.100000
<Atoms.UnitVectors
# comment
 2.0 0.0 0.0
 0.0 3.0 0.0
 0.0 0.0 4.0
Atoms.UnitVectors>
Species.Number   3
<Definition.of.Atomic.Species
 C   C6.0-s2p1   C_PBE19
 Zz  Z6.0-s1     Z_PBE19
 Mo  Mo7.0-s1p1d1 Mo_PBE19
Definition.of.Atomic.Species>
Atoms.SpeciesAndCoordinates.Unit   {unit}
<Atoms.SpeciesAndCoordinates
 1 C  {a}  2.0 1.0
 2 Mo {b}
Atoms.SpeciesAndCoordinates>
 Reciprocal vector b1 (1/Ang):   1.000000   0.500000  -0.250000
 Reciprocal vector b1 (1/Ang):   3.141593   0.000000   0.000000
 Chemical Potential (Hartree) = -0.200000
 Chemical Potential (Hartree) = ******
"""
FINAL = """ Fractional coordinates of the final structure
***
 xx
 yy
 1 C 0.9 0.8 0.7
 2 Mo 0.1 0.2 0.3

"""


def structure(spark, tmp_path, text, name="s.out"):
    (tmp_path / name).write_text(text)
    return L.text_lines(spark, str(tmp_path / name))


def test_structure_output(spark, tmp_path):
    lines = structure(spark, tmp_path, OUT.format(unit="FRAC", a="0.1 0.2 0.3", b="0.5 0.5 0.5"))
    assert np.isclose(C.fermi_levels(lines).first().fermi_ev, -0.2 * 27.211386245988)
    assert [(r.axis, r.x, r.y, r.z) for r in C.unit_cells(lines).orderBy("axis").collect()] == [(1, 2, 0, 0), (2, 0, 3, 0), (3, 0, 0, 4)]
    assert C.reciprocal_vectors(lines).first()[1:] == (1, 3.141593, 0.0, 0.0)
    assert [(r.label, r.n_s, r.n_p, r.n_d) for r in C.species(lines).orderBy("ord").collect()] == [("C", 2, 1, 0), ("Mo", 1, 1, 1)]
    assert C.species_mismatches(lines).first()[1:] == (3, 2)


def test_positions_by_source(spark, tmp_path):
    listed = structure(spark, tmp_path, OUT.format(unit="FRAC", a="0.1 0.2 0.3", b="0.5 0.5 0.5"))
    rows = C.positions(listed, C.unit_cells(listed)).orderBy("ord").collect()
    assert [(r.element, r.f1, r.f3, r.source, r.up) for r in rows] == [("C", 0.1, 0.3, "listed", 2.0), ("Mo", 0.5, 0.5, "listed", None)]
    ang = structure(spark, tmp_path, OUT.format(unit="Ang", a="1.0 1.5 1.0", b="0.5 0.5 0.5"))
    r = C.positions(ang, C.unit_cells(ang)).orderBy("ord").first()
    np.testing.assert_allclose((r.f1, r.f2, r.f3), (0.5, 0.5, 0.25))
    final = structure(spark, tmp_path, OUT.format(unit="FRAC", a="0.1 0.2 0.3", b="0.5 0.5 0.5") + FINAL)
    rows = C.positions(final, C.unit_cells(final)).orderBy("ord").collect()
    assert [(r.f1, r.source, r.up) for r in rows] == [(0.9, "final", 2.0), (0.1, "final", None)]
    none = structure(spark, tmp_path, "nothing\n")
    assert C.without_positions(none, C.positions(none, C.unit_cells(none))).count() == 1


def test_log_reciprocal_vectors(spark, tmp_path):
    lines = structure(spark, tmp_path, "          Reciprocal-Space Vectors (Ang^-1)\n      b_1     1.5 0.25 0.0\n      b_2     0.0 2.5 0.0\n      b_3     0.0 0.0 0.5\n b_1 9 9 9\n", "s.wout")
    assert [(r.axis, r.x, r.y, r.z) for r in C.reciprocal_vectors(lines).orderBy("axis").collect()] == [(1, 1.5, 0.25, 0), (2, 0, 2.5, 0), (3, 0, 0, 0.5)]


def test_lattice_vectors_need_a_source(spark, tmp_path):
    log = "Reciprocal-Space Vectors\n b_1 1 0 0\n b_2 0 1 0\n b_3 0 0 1\n"
    assert C.lattice_vectors(structure(spark, tmp_path, log, "a.wout")).count() == 3
    given = spark.createDataFrame([("f", 1, 2.0, 0.0, 0.0)], "file string, axis int, x double, y double, z double")
    assert C.lattice_vectors(None, given).first().x == 2.0
    with pytest.raises(ValueError, match="neither"):
        C.lattice_vectors()
    with pytest.raises(Exception, match="no three reciprocal vectors"):
        C.lattice_vectors(structure(spark, tmp_path, "nothing\n", "b.wout")).collect()


def test_unfolding_and_map(spark, tmp_path):
    out = structure(spark, tmp_path, OUT.format(unit="FRAC", a="0.1 0.2 0.3", b="0.5 0.5 0.5")).withColumn("file", F.lit("run"))
    cols = C.orbital_columns(C.positions(out, C.unit_cells(out)), C.species(out))
    names = [r["name"] for r in cols.orderBy("position").collect()]
    assert names[:6] == ["0-C-0s", "0-C-1s", "0-C-0px", "0-C-0py", "0-C-0pz", "1-Mo-0s"]
    assert len(names) == 14
    w = np.arange(28).reshape(2, 14) / 10
    (tmp_path / "w.orb").write_text("".join(f"{k} {e} " + " ".join(map(str, r)) + "\n" for k, e, r in zip((0.0, 0.5), (-1.0, 1.0), w, strict=True)))
    weights = C.unfolding(L.text_lines(spark, str(tmp_path / "w.orb")).withColumn("file", F.lit("run")), cols)
    got = [r.w for r in C.selected_weight(weights, element="Mo").orderBy("energy").collect()]
    np.testing.assert_allclose(got, w[:, 5:].sum(1))
    a = jobs.spectral_map(spark, str(tmp_path / "s.out"), str(tmp_path / "w.orb"), 10.0, 4.2, 3, 3, element="Mo")
    assert a.count() == 9
    (tmp_path / "bad.orb").write_text("0 1 2 3\n")
    with pytest.raises(Exception, match="unexpected number of columns"):
        C.unfolding(L.text_lines(spark, str(tmp_path / "bad.orb")).withColumn("file", F.lit("run")), cols).collect()


def test_band_path(spark, tmp_path):
    text = "2 0 0.10\n1 0 0 0 1 0 0 0 1\n2\n3 0 0 0 0.5 0 0 G X\n2 0.5 0 0 0.5 0.5 0 X M\n"
    ks = [(0, 0, 0), (0.25, 0, 0), (0.5, 0, 0), (0.5, 0, 0), (0.5, 0.5, 0)]
    text += "".join(f"2 {a} {b} {c}\n{0.1 * n}\n {0.1 * n + 0.5}\n" for n, (a, b, c) in enumerate(ks))
    points, ticks = C.band_path(structure(spark, tmp_path, text, "s.Band"))
    assert [(r.label, r.kidx) for r in ticks.orderBy("ord").collect()] == [("G", 0), ("X", 2), ("M", 4)]
    rows = points.orderBy("kidx", "band").collect()
    assert len(rows) == 10
    np.testing.assert_allclose([r.dist for r in rows[::2]], np.array([0, 0.25, 0.5, 0.5, 1.0]) * 1.8897261254578281)
    np.testing.assert_allclose([r.energy for r in rows[1::2]], (0.1 * np.arange(5) + 0.4) * 27.211386245988)


def test_dos_tree(spark, tmp_path):
    root = tmp_path / "DOS"
    (root / "atom1").mkdir(parents=True)
    (root / "atomx").mkdir()
    (root / "sys.DOS.T").write_text("# E DOS IDOS\n0 1 0.5\n1 2 1.5\n")
    for s in ("s1", "s2", "p1"):
        (root / f"atom1/sys.PDOS.{s}").write_text("0 1 1\n")
    (root / "atom1/sys.PDOS.atom1").write_text("0 3 3\n")
    (root / "atomx/sys.PDOS.s1").write_text("0 9 9\n")
    got = sorted((r.atom or 0, r.orbital, r.e, r.dos) for r in C.dos_tree(spark, str(root)).collect())
    assert got == [(0, "total", 0, 1), (0, "total", 1, 2), (1, "p1", 0, 1), (1, "s1", 0, 1), (1, "s2", 0, 1), (1, "total", 0, 3)]
    (root / "sys2.DOS.T").write_text("0 1 1\n")
    with pytest.raises(Exception, match="several totals"):
        C.dos_tree(spark, str(root)).collect()


def cube_text(values, n1=1):
    head = f"c1\nc2\n1 0.0 0.0 0.0\n{n1} 0.5 0 0\n2 0 0.5 0\n4 0 0 0.5\n6 4.0 0.1 0.2 0.3\n"
    v = [str(x) for x in values]
    return head + "\n".join(" ".join(v[i : i + 6]) for i in range(0, len(v), 6)) + "\n"


def test_cubes(spark, tmp_path):
    (tmp_path / "a.cube").write_text(cube_text(range(8)))
    (tmp_path / "b.cube").write_text(cube_text([2 * x for x in range(8)]))
    (tmp_path / "c.cube").write_text(cube_text(range(16), 2))
    meta, atoms, voxels = C.cubes(L.text_lines(spark, str(tmp_path)))
    assert (meta.count(), atoms.count(), voxels.count()) == (3, 3, 32)
    assert atoms.first()[1:] == (1, 6, 4.0, 0.1, 0.2, 0.3)
    of = lambda c: voxels.where(F.col("cube_id").endswith(c))
    got = {(r.i, r.j, r.k): r.value for r in voxel.difference(of("b.cube"), of("a.cube")).collect()}
    assert got[0, 1, 2] == 6.0
    ids = {i.rsplit("/")[-1]: i for (i,) in meta.select("cube_id").collect()}
    pairs = spark.createDataFrame([(ids["a.cube"], ids["b.cube"]), (ids["a.cube"], ids["c.cube"])], "first string, second string")
    assert [(r.ok, r.differs) for r in voxel.compatible(meta, pairs).orderBy("second").collect()] == [(True, []), (False, ["n1"])]


LOG = """*------------------------------- DISENTANGLE --------------------------------*
|  Convergence tolerence                     :         1.000E-08             |
*----------------------------------------------------------------------------*
      1     413.16891841     405.30583437       1.940E-02      0.00    <-- DIS
      2     413.0            405.2              2.0E-03        0.10    <-- DIS
*------------------------------- WANNIERISE ---------------------------------*
|  Convergence tolerence                     :         0.200E-09             |
 Initial State
  WF centre and spread    1  (  1.985112,  3.438416,100.291488 )     6.75594284
  WF centre and spread    2  (  1.985112,  3.438416,100.291488 )     5.5
        O_D=      0.1 O_OD=      0.2 <-- DLTA
 Cycle:      1
  WF centre and spread    1  (  1.985112,  3.438416,100.291488 )     4.5
        O_D=      0.05 O_OD=      0.2 <-- DLTA
"""


def test_convergence_log(spark, tmp_path):
    settings, dis, spreads, ods = C.convergence_logs(structure(spark, tmp_path, LOG, "s.wout"))
    assert sorted((r.section, r.tolerance) for r in settings.collect()) == [("disentangle", 1e-8), ("wannierise", 2e-10)]
    assert [(r.iter, r.delta, r.time) for r in dis.orderBy("iter").collect()] == [(1, 0.0194, 0.0), (2, 0.002, 0.1)]
    assert sorted((r.cycle, r.wf, r.spread) for r in spreads.collect()) == [(0, 1, 6.75594284), (0, 2, 5.5), (1, 1, 4.5)]
    assert sorted((r.cycle, r.od) for r in ods.collect()) == [(0, 0.1), (1, 0.05)]


def test_store_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "s")
    for v in (1.0, 2.0):
        grid = spark.createDataFrame([(layer, i, j, v) for layer in (0, 1) for i in range(2) for j in range(2)], "layer int, i int, j int, v double")
        store.save(grid, path, "r", "grid", 2, [0.1, 0.2], eta=v, extra={"a": "b"})
    got = store.load(spark, path, "r", layers=[1])
    assert {r.v for r in got.collect()} == {2.0}
    assert got.count() == 4
    assert store.runs(spark, path).first().eta == 2.0
    assert "PartitionFilters: [isnotnull(run_id" in got._jdf.queryExecution().executedPlan().toString()


def test_densities_of_a_run_do_not_meet_by_run(spark):
    """One run's rows stay in the tasks that read them."""
    rows = C.dos_rows(spark.range(0, 1000, 1, 8).selectExpr("concat('run/DOS/atom1/x.s', id % 9) file", "'1 2 3' line"))
    assert rows.rdd.getNumPartitions() == 8
    assert rows.count() == 1000


def test_parts_of_a_folder_are_one_text(spark, tmp_path):
    """Files of a folder in the order of their names, each with splits of its own."""
    for text in ("a", "b"):
        (tmp_path / text).mkdir()
        for part in range(3):
            (tmp_path / text / f"part-0000{part}.txt").write_text("".join(f"{text}{part * 10 + k}\n" for k in range(10)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = L.file_lines(spark, str(tmp_path), recursive=True, parts=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file[-2:], r.ln, r.line) for r in got) == [(f"{t}/", n, f"{t}{n}") for t in "ab" for n in range(30)]
