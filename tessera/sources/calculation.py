"""Calculation outputs: structures, bands, densities of states, unfolding weights, cubes, hopping tables, convergence logs.

Each reader takes a line table (file, ln, line) and gives long tables; one job handles any number of files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ANGSTROM_BOHR, BOHR_ANGSTROM, HARTREE_EV
from ..operators import scan
from . import lines as L

# Orbitals of a shell in the order of the weight columns.
SHELL_ORBITALS = {"s": ("s",), "p": ("px", "py", "pz"), "d": ("d3z^2-r^2", "dx^2-y^2", "dxy", "dxz", "dyz")}
# Element symbols by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def _tok(i: int):
    return F.get(F.col("t"), F.lit(i))


def _num(i: int):
    return L.number(_tok(i))


def fermi_levels(lines: DataFrame) -> DataFrame:
    """(file, fermi_ev): from the last chemical potential that can be read."""
    raw = F.regexp_extract("line", r"Chemical Potential \(Hartree\)\s*[=:]?\s*(\S+)", 1)
    return L.last_value(lines.where(F.contains(F.col("line"), F.lit("Chemical Potential (Hartree)"))), L.number(raw) * HARTREE_EV, "fermi_ev")


def _size(whole: bool) -> int | None:
    return None if whole else scan.CHUNK


def unit_cells(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file, axis, x, y, z): the first three rows of the unit-vector block."""
    rows = L.nth(L.named_block(lines, "Atoms.UnitVectors", whole), "axis", size=_size(whole)).where("axis <= 3").withColumn("t", L.tokens(F.col("line")))
    return rows.select("file", "axis", *[_num(i).alias(c) for i, c in enumerate("xyz")])


def reciprocal_vectors(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file, axis, x, y, z) from either log dialect; the last mention of an axis wins.

    `Reciprocal vector b1 (1/Ang): x y z` lines, or the three `b_1 x y z` lines below `Reciprocal-Space Vectors`."""
    number = r"[-+]?\d*\.?\d+(?:[eEdD][-+]?\d+)?"
    has = lambda text: F.contains(F.col("line"), F.lit(text))
    plain = F.when(has("Reciprocal vector b"), F.regexp_extract("line", r"Reciprocal vector b([123])", 1))
    is_head = has("Reciprocal-Space Vectors")
    some = lines.where(has("Reciprocal") | has("b_"))  # the only lines that matter, in either dialect
    if whole:
        before = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
        near = some.withColumn("below", F.col("ln") - F.last(F.when(is_head, F.col("ln")), ignorenulls=True).over(before) <= 3)
    else:
        heads = some.where(is_head).select("file", F.explode(F.array(*[F.col("ln") + d for d in (1, 2, 3)])).alias("ln")).distinct()
        near = some.join(heads.withColumn("below", F.lit(True)), ["file", "ln"], "left")
    under = F.when(F.col("below"), F.regexp_extract("line", r"^\s*b_([123])\s", 1))
    axis = F.coalesce(F.nullif(plain, F.lit("")), F.nullif(under, F.lit(""))).try_cast("int")
    tail = F.regexp_replace("line", r"^.*?b_?[123]\s*(\([^)]*\))?\s*:?", "")
    rows = L.once(L.once(near, "axis", axis).where("axis is not null"), "v", F.regexp_extract_all(tail, F.lit(f"({number})"), F.lit(1))).where(F.size("v") >= 3)
    last = rows.groupBy("file", "axis").agg(F.max_by("v", "ln").alias("v"))
    return last.select("file", "axis", *[L.number(F.get("v", F.lit(i))).alias(c) for i, c in enumerate("xyz")])


def lattice_vectors(lines: DataFrame | None = None, given: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(file, axis, x, y, z): the given vectors, else those of the logs. Neither, or a log without all three, is an error."""
    if given is not None:
        return given
    if lines is None:
        raise ValueError("neither a log nor vectors are given")
    files = lines.where("ln = 0") if whole else lines  # a whole text has a first line
    found = files.select("file").distinct().join(reciprocal_vectors(lines, whole), "file", "left")  # left: the check is made even where nothing is found
    axes = found.withColumn("axes", F.count("axis").over(Window.partitionBy("file")))  # three rows at most
    ok = F.when(F.col("axes") == 3, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no three reciprocal vectors in "), "file")).cast("boolean"))
    return axes.where(ok).select("file", "axis", "x", "y", "z")


def species(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file, ord, label, basis, potential, n_s, n_p, n_d) of the species block; labels that are no element are left out."""
    rows = L.nth(L.named_block(lines, "Definition.of.Atomic.Species", whole).withColumn("t", L.tokens(F.col("line"))), "ord", size=_size(whole)).where(F.size("t") >= 2)
    out = rows.select("file", "ord", _tok(0).alias("label"), _tok(1).alias("basis"), _tok(2).alias("potential"))
    out = out.where(F.regexp_extract("label", r"^([A-Z][a-z]?)", 1).isin(ELEMENTS))
    return out.withColumns({f"n_{s}": shell_count(F.col("basis"), s) for s in "spd"})


def shell_count(basis, shell: str):
    """Shells of a kind in a basis such as `C6.0-s3p2d1`: 0 if not named, null without a dash."""
    found = F.nullif(F.regexp_extract(basis, rf"^[^-]*-.*?{shell}(\d+)", 1), F.lit("")).try_cast("int")  # a cast that fails costs more than all else here
    return F.when(F.contains(basis, F.lit("-")), F.coalesce(found, F.lit(0)))


def species_mismatches(lines: DataFrame) -> DataFrame:
    """(file, stated, found) where the stated number of species is not that of the block."""
    stated = L.last_value(lines, F.regexp_extract("line", r"^\s*Species\.Number\s+(\d+)", 1).try_cast("int"), "stated")
    found = species(lines).groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("found"))
    return stated.join(found, "file", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("stated <> found")


def final_positions(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file, ord, element, f1, f2, f3) of the final structure, fractional."""
    t = F.trim("line")
    body = L.after_until(lines, F.contains(F.col("line"), F.lit("Fractional coordinates of the final structure")), 4, (t == "") | F.startswith(t, F.lit("*")) | ~t.rlike(r"^\d"), whole)
    rows = L.nth(body.withColumn("t", L.tokens(F.col("line"))), "ord", size=_size(whole))
    return rows.select("file", "ord", _tok(1).alias("element"), *[_num(i + 2).alias(f"f{i + 1}") for i in range(3)])


def listed_positions(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(file, ord, element, c1, c2, c3, unit, up, down) of the species-and-coordinates block; unit FRAC unless stated."""
    is_unit = F.contains(F.col("line"), F.lit("SpeciesAndCoordinates.Unit"))
    unit = F.when(is_unit, F.upper(F.nullif(F.regexp_extract("line", r"^\s*Atoms\.SpeciesAndCoordinates\.Unit\s+(\S+)", 1), F.lit(""))))
    stated = L.marked(lines.withColumn("_unit", unit), {"unit": F.max_by("_unit", F.when(F.col("_unit").isNotNull(), F.col("ln")))}, whole)
    rows = L.named_block(stated.where(~is_unit), "Atoms.SpeciesAndCoordinates", whole).withColumn("t", L.tokens(F.col("line"))).where(F.size("t") >= 5)
    out = rows.select("file", _tok(0).try_cast("int").alias("ord"), _tok(1).alias("element"), *[_num(i + 2).alias(f"c{i + 1}") for i in range(3)], _num(5).alias("up"), _num(6).alias("down"), F.coalesce("unit", F.lit("FRAC")).alias("unit"))
    return out.select("file", "ord", "element", "c1", "c2", "c3", "unit", "up", "down")


def positions(lines: DataFrame, cells: DataFrame, order: dict[str, int] | None = None, whole: bool = False) -> DataFrame:
    """(file, ord, element, f1, f2, f3, source, up, down): the final structure, else the listed one (Angstrom turned to fractions).

    Spins come from the list by number, wherever the place comes from. A file with neither is missing (see without_positions)."""
    from ..operators import lattice

    if whole:
        return _positions_of_whole(lines, cells)
    listed = listed_positions(lines)
    frac = listed.where("unit = 'FRAC'").select("file", "ord", "element", *[F.col(f"c{i}").alias(f"f{i}") for i in (1, 2, 3)])
    ang = listed.where("unit = 'ANG'").select(F.col("file").alias("system_id"), F.col("ord").alias("item"), *[F.col(f"c{i + 1}").alias(c) for i, c in enumerate("xyz")])
    conv = lattice.to_fractional(ang, cells.withColumnRenamed("file", "system_id")).select(F.col("system_id").alias("file"), F.col("item").alias("ord"), "f1", "f2", "f3").join(listed.select("file", "ord", "element"), ["file", "ord"]).select("file", "ord", "element", "f1", "f2", "f3")
    ranked = final_positions(lines).withColumns({"rank": F.lit(0), "source": F.lit("final")}).unionByName(frac.unionByName(conv).withColumns({"rank": F.lit(1), "source": F.lit("listed")}))
    best = ranked.groupBy("file").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["file", "rank"]).drop("rank").join(listed.select("file", "ord", "up", "down"), ["file", "ord"], "left")


def _positions_of_whole(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """positions() with the final and the listed rows of a file brought together once, instead of a join for each question asked of them."""
    from ..operators import lattice

    listed = listed_positions(lines, True).withColumnsRenamed({f"c{i}": f"f{i}" for i in (1, 2, 3)}).withColumns({"rank": F.lit(1), "source": F.lit("listed")})
    final = final_positions(lines, True).withColumns({"rank": F.lit(0), "source": F.lit("final")})
    both = final.unionByName(listed, allowMissingColumns=True).repartition("file")
    spins = F.collect_list(F.when((F.col("rank") == 1) & F.col("ord").isNotNull(), F.struct("up", "down"))).over(Window.partitionBy("file", "ord"))
    both = both.withColumn("_spin", spins).select("file", "ord", "element", "f1", "f2", "f3", "unit", "rank", "source", F.explode_outer("_spin").alias("_spin"))
    basis = lattice.dual(lattice.wide(cells.withColumnRenamed("file", "system_id"))).withColumnRenamed("system_id", "file")
    turn = lambda k: sum((F.col(f"f{i}") * F.col(f"b{k}{c}") for i, c in ((2, "y"), (3, "z"))), F.col("f1") * F.col(f"b{k}x")) / (2 * math.pi)
    is_ang = F.col("unit") == "ANG"
    placed = both.join(basis.withColumn("_cell", F.lit(True)), "file", "left").where("rank = 0 or unit = 'FRAC' or unit = 'ANG' and _cell and ord is not null")
    placed = placed.select("file", "ord", "element", *[F.when(is_ang, turn(k)).otherwise(F.col(f"f{k}")).alias(f"f{k}") for k in (1, 2, 3)], "source", "rank", "_spin.up", "_spin.down")
    return placed.withColumn("_best", F.min("rank").over(Window.partitionBy("file"))).where("rank = _best").drop("rank", "_best")


def without_positions(lines: DataFrame, found: DataFrame) -> DataFrame:
    return lines.select("file").distinct().join(found.select("file").distinct(), "file", "left_anti")


def orbital_columns(atoms: DataFrame, shells: DataFrame) -> DataFrame:
    """(file, position, name, atom, element, orbital): the order of weight columns.

    atoms (file, ord, element) join shells (file, label, n_s, n_p, n_d); an element without shells is an error."""
    both = atoms.join(shells.select("file", F.col("label").alias("element"), "n_s", "n_p", "n_d"), ["file", "element"], "left")
    checked = both.withColumn("n_s", F.coalesce("n_s", F.raise_error(F.concat(F.lit("no basis for "), "element")).cast("int")))
    def shells_of(s: str):
        names = F.array(*map(F.lit, SHELL_ORBITALS[s]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.col(f"n_{s}") - 1), lambda m: F.transform(names, lambda o: F.concat(m.cast("string"), o))))

    parts = [shells_of(s) for s in "spd"]
    lists = [F.when(F.col(f"n_{s}") > 0, p).otherwise(F.array().cast("array<string>")) for s, p in zip("spd", parts, strict=True)]
    each = checked.select("file", "ord", "element", F.posexplode(F.concat(*lists)).alias("n", "orbital"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("ord", "n")) - 1
    rank = F.dense_rank().over(Window.partitionBy("file").orderBy("ord")) - 1
    return each.select("file", pos.alias("position"), rank.alias("atom"), "element", "orbital").withColumn("name", F.concat_ws("-", "atom", "element", "orbital"))


def unfolding(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """(file, row_id, kpath, energy, position, atom, element, orbital, weight); kpath in inverse Angstrom. A row of another width is an error.

    columns: (file, position, atom, element, orbital), or without file for columns that all files have: these are one row, sent to the lines where they are, so that no line is sorted or sent."""
    keys = [c for c in columns.columns if c == "file"]
    want = columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("position", "atom", "element", "orbital")).alias("c"))  # as many as a line has words
    rows = lines.where(F.trim("line") != "").select("file", "ln", "line")
    rows = rows.join(want, keys) if keys else rows.crossJoin(F.broadcast(want))
    rows = L.once(rows, "t", L.tokens(F.col("line"))).drop("line")  # words after the meeting, as a sort for it would hold them
    rows = rows.where(F.when(F.size("t") == F.col("n") + 2, F.size("t") > 2).otherwise(F.raise_error("unexpected number of columns").cast("boolean")))
    each = rows.select("file", F.col("ln").alias("row_id"), (_num(0) / BOHR_ANGSTROM).alias("kpath"), _num(1).alias("energy"), "t", "n", F.explode("c").alias("c")).where("c.position >= 0 and c.position < n")
    return each.select("file", "row_id", "kpath", "energy", "c.position", "c.atom", "c.element", "c.orbital", L.number(F.get("t", F.col("c.position") + 2)).alias("weight"))


def selected_weight(weights: DataFrame, element: str | None = None, atom: int | None = None) -> DataFrame:
    """Per row, the weights of an element or an atom (all without either), summed."""
    rows = weights
    if element is not None:
        rows = rows.where(F.col("element") == element)
    if atom is not None:
        rows = rows.where(F.col("atom") == atom)
    return rows.groupBy("file", "row_id", "kpath", "energy").agg(F.sum("weight").alias("w"))


def band_path(lines: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """band_point (file, kidx, k1, k2, k3, dist, band, energy in eV from the chemical potential) and band_tick (file, ord, label, kidx)."""
    rows = L.nth(lines.where(F.trim("line") != "").withColumn("t", L.tokens(F.col("line"))), "n", size=_size(whole))
    basis = [f"b{k}{x}" for k in (1, 2, 3) for x in "xyz"]
    stated = {"nband": (1, _tok(0).try_cast("int")), "mu": (1, _num(2)), "paths": (3, _tok(0).try_cast("int"))} | {b: (2, _num(i) * ANGSTROM_BOHR) for i, b in enumerate(basis)}
    if whole:
        body = L.marked(rows, {c: F.max(F.when(F.col("n") == n, value)) for c, (n, value) in stated.items()}, whole)
    else:
        body = rows
        for n in (1, 2, 3):
            body = body.join(rows.where(F.col("n") == n).select("file", *[value.alias(c) for c, (at, value) in stated.items() if at == n]), "file")
    segments = body.where("n > 3 and n <= 3 + paths").select("file", (F.col("n") - 3).alias("ord"), _tok(0).try_cast("int").alias("points"), _tok(7).alias("first_label"), _tok(8).alias("label"))
    both = F.col("label").isNotNull() & F.col("first_label").isNotNull()
    segments = segments.withColumn("label", F.when(both, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("a segment without two labels in "), "file")).cast("string")))
    upto = scan.running_sum(segments, ["file"], "ord", F.col("points"), "upto", _size(whole))
    tick = F.struct("ord", "label", (F.col("upto") - 1).cast("int").alias("kidx"))
    first = F.struct(F.lit(0).alias("ord"), F.col("first_label").alias("label"), F.lit(0).alias("kidx"))
    ticks = upto.select("file", F.explode(F.when(F.col("ord") == 1, F.array(first, tick)).otherwise(F.array(tick))).alias("k")).select("file", "k.*")
    data = body.where("n > 3 + paths")
    is_head = (F.size("t") == 4) & (_tok(0).try_cast("int") == F.col("nband"))
    own = {f"k{i}": _num(i) for i in (1, 2, 3)}
    place = {c: sum((F.col(f"k{i}") * F.col(f"b{i}{c}") for i in (2, 3)), F.col("k1") * F.col(f"b1{c}")) for c in "xyz"}
    if whole:
        return _points_of_whole(data.withColumns(own).withColumns(place), is_head), ticks
    recs = L.numbered(data, is_head, "kidx", order="n").withColumn("kidx", F.col("kidx") - 1)
    k = recs.where(is_head).select("file", "kidx", *[value.alias(c) for c, value in own.items()], *basis).withColumns(place)
    k = path_length(k).select("file", "kidx", "k1", "k2", "k3", "dist")
    values = recs.where(~is_head).groupBy("file", "kidx", "nband", "mu").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("c"))  # the lines of one k-point
    energies = values.select("file", "kidx", "mu", F.posexplode(F.slice(F.flatten(F.transform("c", lambda x: x["t"])), F.lit(1), F.col("nband"))).alias("band", "e"))
    return k.join(energies, ["file", "kidx"]).select("file", "kidx", "k1", "k2", "k3", "dist", "band", ((L.number(F.col("e")) - F.col("mu")) * HARTREE_EV).alias("energy")), ticks


def _points_of_whole(rows: DataFrame, is_head: Column) -> DataFrame:
    """The points of band_path() by windows in the order of a file's lines: the lines of values take over what their point's head line states.

    Two rounds of windows: the second asks for sums of the first. rows: (file, ln, t, nband, mu, k1, k2, k3, x, y, z), where only head lines have points."""
    upto = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_h", F.coalesce(is_head, F.lit(False)))
    is_value = ~is_head
    rows = rows.withColumns({
        "kidx": F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(upto), "_p": F.last(F.when(F.col("_h"), F.struct("x", "y", "z")), ignorenulls=True).over(before),
        "_w": F.sum(F.when(is_value, F.size("t"))).over(upto),
    })
    step = F.sqrt(sum(((F.col(c) - F.col(f"_p.{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_p.x")) ** 2))
    point = F.struct("k1", "k2", "k3", F.coalesce("_w", F.lit(0)).alias("w"))
    rows = rows.withColumns({"dist": F.sum(F.when(F.col("_h"), F.coalesce(step, F.lit(0.0)))).over(upto), "_k": F.last(F.when(F.col("_h"), point), ignorenulls=True).over(upto)})  # the length is that of the point up to the next one
    rows = rows.withColumn("kidx", (F.col("kidx") - 1).cast("int")).where(is_value & (F.col("kidx") >= 0))
    each = rows.select("file", "kidx", "_k.k1", "_k.k2", "_k.k3", "dist", "nband", "mu", F.posexplode("t").alias("p", "e"), (F.col("_w") - F.size("t") - F.col("_k.w")).alias("_before"))
    each = each.withColumn("band", (F.col("_before") + F.col("p")).cast("int")).where("band < nband")
    return each.select("file", "kidx", "k1", "k2", "k3", "dist", "band", ((L.number(F.col("e")) - F.col("mu")) * HARTREE_EV).alias("energy"))


def path_length(points: DataFrame, key: str = "file", order: str = "kidx", size: int = scan.CHUNK) -> DataFrame:
    """points (key, order 0, 1, ..., x, y, z) with dist: the length of the path up to each. A point meets the one before it by number."""
    before = points.select(key, (F.col(order) + 1).alias(order), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    step = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_x")) ** 2))
    steps = points.join(before, [key, order], "left").withColumn("_step", F.coalesce(step, F.lit(0.0))).drop("_x", "_y", "_z")
    return scan.running_sum(steps, [key], order, F.col("_step"), "dist", size).drop("_step")


def dos_tree(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files of a tree (see dos_rows). Lines carry their own energies, so files are read line-parallel."""
    return dos_rows(spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))


def dos_rows(lines: DataFrame) -> DataFrame:
    """(file, atom, orbital, e, dos, idos) of (file, line): total and per-atom densities; `total` or the suffix of the file's name is the orbital.

    More than one total outside atom folders of one run, the folder that holds them, is an error; a tree may hold many runs."""
    atom = F.regexp_extract("file", r"/atom(\d+)/[^/]*$", 1).try_cast("int")
    other = F.col("file").rlike(r"/atom[^/]*/[^/]*$") & atom.isNull()
    suffix = F.regexp_extract("file", r"\.([spd]\d+)$", 1)
    rows = lines.where(~F.startswith(F.trim(F.col("line")), F.lit("#")) & (F.trim("line") != "")).withColumn("t", L.tokens(F.col("line")))
    out = rows.where(~other).select("file", atom.alias("atom"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("total")).alias("orbital"), _num(0).alias("e"), _num(1).alias("dos"), _num(2).alias("idos"))
    run = F.regexp_replace("file", r"(/atom[^/]*)?/[^/]*$", "")
    totals = out.where("atom is null").groupBy(run.alias("_run")).agg(F.count_distinct("file").alias("_totals"))
    bad = totals.where("_totals > 1").select("_run", F.lit(True).alias("_bad"))  # mostly none, so rows need not meet by run, of which a tree may have one
    checked = out.withColumn("_run", run).join(F.broadcast(bad), "_run", "left")
    return checked.where(F.when(F.col("_bad").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("several totals in "), "_run")).cast("boolean"))).drop("_run", "_bad")


def hopping_tables(lines: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """header (system_id, num_wann, nrpts), hopping (system_id, r1, r2, r3, m, n, re, im, ndegen), and the rows with too few tokens.

    A first line that is no number is a comment. Degeneracies follow the header in order of the R blocks."""
    rows = lines.where(F.trim("line") != "").withColumn("t", L.tokens(F.col("line"))).withColumnRenamed("file", "system_id")
    rows = L.nth(rows, "n", "system_id", _size(whole))
    if whole:
        return _hopping_of_whole(rows)
    first = rows.where("n = 1").select("system_id", F.when(_tok(0).try_cast("int").isNull() | (F.size("t") > 1), 1).otherwise(0).alias("skip"))
    rows = rows.join(first, "system_id").withColumn("n", F.col("n") - F.col("skip")).where("n >= 1")
    header = rows.where("n = 1").select("system_id", _tok(0).try_cast("int").alias("num_wann")).join(rows.where("n = 2").select("system_id", _tok(0).try_cast("int").alias("nrpts")), "system_id")
    body = rows.where("n > 2").join(header, "system_id")
    body = scan.running_sum(body, ["system_id"], "n", F.size("t"), "upto")
    degens = body.where((F.col("upto") <= F.col("nrpts"))).select("system_id", F.posexplode("t").alias("p", "d"), (F.col("upto") - F.size("t")).alias("before")).select("system_id", (F.col("before") + F.col("p")).cast("int").alias("block"), L.number(F.col("d")).alias("ndegen"))
    data = body.where(F.col("upto") > F.col("nrpts"))
    good = data.where(F.size("t") >= 7).select("system_id", "n", "num_wann", *[_tok(i).try_cast("int").alias(c) for i, c in enumerate(("r1", "r2", "r3", "m", "k"))], _num(5).alias("re"), _num(6).alias("im"))
    starts = good.groupBy("system_id", "r1", "r2", "r3").agg(F.min("n").alias("at"))
    starts = starts.withColumn("block", F.row_number().over(Window.partitionBy("system_id").orderBy("at")) - 1)
    hopping = good.join(starts.drop("at"), ["system_id", "r1", "r2", "r3"]).join(degens, ["system_id", "block"], "left").select("system_id", "r1", "r2", "r3", (F.col("m") - 1).alias("m"), (F.col("k") - 1).alias("n"), "re", "im", "ndegen")
    return header, hopping, data.where(F.size("t") < 7).select("system_id", "ln", "line")


def _hopping_of_whole(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hopping_tables() by windows over a file's lines: a block takes its degeneracy over by its number, among the rows of its own file.

    rows: (system_id, ln, line, t, n)."""
    of = lambda *keys: Window.partitionBy("system_id", *keys)
    at = lambda n, value: F.max(F.when(F.col("n") == n, value))
    rows = L.marked(rows, {"skip": at(1, F.when(_tok(0).try_cast("int").isNull() | (F.size("t") > 1), 1).otherwise(0))}, True, "system_id").withColumn("n", F.col("n") - F.col("skip")).where("n >= 1")
    rows = L.marked(rows, {"num_wann": at(1, _tok(0).try_cast("int")), "nrpts": at(2, _tok(0).try_cast("int"))}, True, "system_id")
    header = rows.where("n = 2").select("system_id", "num_wann", "nrpts")
    body = scan.running_sum(rows.where("n > 2"), ["system_id"], "ln", F.size("t"), "upto", None)
    is_row = F.col("upto") > F.col("nrpts")
    before = F.col("upto") - F.size("t")
    none = F.array(F.struct(F.lit(None).cast("int").alias("block"), F.lit(None).cast("double").alias("ndegen")))
    degens = F.when(~is_row, F.transform("t", lambda d, p: F.struct((before + p).cast("int").alias("block"), L.number(d).alias("ndegen")))).otherwise(none)
    known = body.where(~is_row | is_row & (F.size("t") >= 7)).withColumn("is_row", is_row)
    numbers = [F.when(F.col("is_row"), _tok(i).try_cast("int")).alias(c) for i, c in enumerate(("r1", "r2", "r3", "m", "k"))]
    known = known.select("system_id", "n", "is_row", *numbers, F.when(F.col("is_row"), _num(5)).alias("re"), F.when(F.col("is_row"), _num(6)).alias("im"), F.explode(degens).alias("d"))
    known = known.where("not is_row or r1 is not null and r2 is not null and r3 is not null")
    known = known.withColumn("at", F.min("n").over(of("is_row", "r1", "r2", "r3")))
    known = known.withColumn("block", F.when(F.col("is_row"), F.dense_rank().over(of("is_row").orderBy("at")) - 1).otherwise(F.col("d.block")))
    known = known.withColumn("ndegen", F.max("d.ndegen").over(of("block"))).where("is_row")
    hopping = known.select("system_id", "r1", "r2", "r3", (F.col("m") - 1).alias("m"), (F.col("k") - 1).alias("n"), "re", "im", "ndegen")
    return header, hopping, body.where(is_row & (F.size("t") < 7)).select("system_id", "ln", "line")


def cubes(lines: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cube_meta (cube_id, n1.., ox.., a1x..), cube_atom (cube_id, ord, number, charge, x, y, z), voxel (cube_id, i, j, k, value)."""
    rows = lines.where(F.trim("line") != "").withColumn("t", L.tokens(F.col("line"))).withColumnRenamed("file", "cube_id")
    head = rows.where("ln = 2").select("cube_id", _tok(0).try_cast("int").alias("natoms"), *[_num(i + 1).alias(f"o{c}") for i, c in enumerate("xyz")])
    meta = head
    for a in (1, 2, 3):
        meta = meta.join(rows.where(F.col("ln") == 2 + a).select("cube_id", _tok(0).try_cast("int").alias(f"n{a}"), *[_num(i + 1).alias(f"a{a}{c}") for i, c in enumerate("xyz")]), "cube_id")
    if whole:
        stated = {"natoms": 2, "n1": 3, "n2": 4, "n3": 5}
        marks = {c: F.max(F.when(F.col("ln") == at, _tok(0).try_cast("int"))) for c, at in stated.items()} | {"_heads": F.count(F.when(F.col("ln").between(2, 5), 1))}
        body = L.marked(rows, marks, whole, "cube_id").where("_heads = 4").drop("_heads")
    else:
        body = rows.join(meta.select("cube_id", "natoms", "n1", "n2", "n3"), "cube_id")
    atoms = body.where("ln > 5 and ln <= 5 + natoms").select("cube_id", (F.col("ln") - 5).alias("ord"), _tok(0).try_cast("int").alias("number"), *[_num(i + 1).alias(c) for i, c in enumerate(("charge", "x", "y", "z"))])
    data = body.where("ln > 5 + natoms")
    flat = scan.running_sum(data, ["cube_id"], "ln", F.size("t"), "before", _size(whole), inclusive=False).select("cube_id", "n2", "n3", F.posexplode("t").alias("p", "v"), "before").withColumn("at", F.col("before") + F.col("p"))
    voxel = flat.select("cube_id", F.expr("cast(at div (n2 * n3) as int)").alias("i"), F.expr("cast((at div n3) % n2 as int)").alias("j"), F.expr("cast(at % n3 as int)").alias("k"), L.number(F.col("v")).alias("value"))
    return meta, atoms, voxel


def convergence_logs(lines: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """log_setting (file, section, tolerance), log_disentangle (file, iter, delta, time), log_spread (file, cycle, wf, spread), log_od (file, cycle, od).

    cycle 0 is the initial state. Incomplete last cycles are kept as they are."""
    marker = F.when(F.contains(F.col("line"), F.lit("DISENTANGLE")), "disentangle").when(F.contains(F.col("line"), F.lit("WANNIERISE")), "wannierise")
    has = lambda text: F.contains(F.col("line"), F.lit(text))
    tol = F.nullif(F.regexp_extract("line", r"Convergence tolerence\s*:?\s*(\S+)", 1), F.lit(""))
    stated = L.carried(lines.where(marker.isNotNull() | has("Convergence tolerence")), marker, "section", size=_size(whole))  # a scan is of the lines that it concerns
    cycle = F.when(has("Initial State"), 0).when(has("Cycle:"), F.regexp_extract("line", r"Cycle:\s*(\d+)", 1).try_cast("int"))
    rows = L.carried(lines.where(has("Initial State") | has("Cycle:") | has("WF centre and spread") | has("DLTA")), cycle, "cycle", size=_size(whole))
    settings = L.once(stated, "tolerance", L.number(tol)).where("tolerance is not null and section is not null").select("file", "section", "tolerance")
    t = L.once(L.once(lines.where(has("<-- DIS")), "line", F.substring_index("line", "<--", 1)), "t", L.tokens(F.col("line")))
    dis = L.once(t, "iter", _tok(0).try_cast("int")).where("iter is not null").select("file", "iter", _num(3).alias("delta"), _num(4).alias("time"))
    spread = F.regexp_extract("line", r"WF centre and spread\s+(\d+)\s*\(.*\)\s*(\S+)", 2)
    wf = F.regexp_extract("line", r"WF centre and spread\s+(\d+)", 1).try_cast("int")
    spreads = rows.where(has("WF centre and spread")).withColumn("wf", wf).withColumn("spread", L.number(spread)).where("wf is not null and cycle is not null").select("file", "cycle", "wf", "spread")
    od = F.regexp_extract("line", r"O_D=\s*(\S+)", 1)
    ods = L.once(rows.where(has("DLTA")), "od", L.number(od)).where("od is not null").select("file", "cycle", "od")
    return settings, dis, spreads, ods
