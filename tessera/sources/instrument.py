"""Instrument files: scan images, point spectra, spectrum grids. Bodies are decoded in Arrow batches, a file at a time.

NaN is a value that the instrument recorded; null is a sample that a truncated file lacks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lines as L

_CHUNK = 1 << 16
_HEADS = 1024  # layouts that a task keeps


def _padded(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n big-endian floats as doubles, and which are there."""
    have = min(n, len(body) // 4)
    out, there = np.zeros(n), np.zeros(n, bool)
    out[:have] = np.frombuffer(body, ">f4", have)
    there[:have] = True
    return out, there


def _numbers(bodies: tuple[bytes, ...], sizes: list[int]) -> pa.Array:
    """Big-endian floats as doubles: of each body its first numbers, as many as its size; null where it ends before."""
    whole = [body if len(body) == 4 * n else body[: min(4 * n, len(body) // 4 * 4)].ljust(4 * n, b"\0") for body, n in zip(bodies, sizes, strict=True)]
    piece, at = _within(sizes)
    there = at < np.array([len(b) // 4 for b in bodies], np.int64)[piece]
    return pa.array(np.frombuffer(b"".join(whole), ">f4").astype(float), mask=~there)


def _within(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these sizes, one after another: each row's piece, and its number in the piece."""
    piece = np.repeat(np.arange(len(sizes)), sizes)
    return piece, np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _entry(head: str, key: str) -> str:
    m = re.search(rf"^:{re.escape(key)}:\s*\n(.*?)(?=^:[^:\n]+:\s*$|\Z)", head, re.S | re.M)
    return m[1].strip() if m else ""


def image_head(data: bytes, seen: dict | None = None) -> tuple[list[str], int, int, int] | None:
    """Channel names, columns, rows, and where the samples begin. seen: the layouts of heads met before, as the images of a run share theirs."""
    mark = data.find(b":SCANIT_END:")
    if mark < 0:
        return None
    stated, seen = data[:mark], {} if seen is None else seen
    if stated not in seen:
        if len(seen) >= _HEADS:
            seen.clear()
        seen[stated] = _image_layout(stated)
    layout = seen[stated]
    if layout is None:
        return None
    body = mark
    for _ in range(3):  # the marker's own line and two more
        body = data.find(b"\n", body) + 1
    return *layout, body + 2


def _image_layout(stated: bytes) -> tuple[list[str], int, int] | None:
    head = stated.decode("latin-1").replace("\r\n", "\n")
    pixels = _entry(head, "SCAN_PIXELS").split()
    if len(pixels) < 2:
        return None
    rows = [r.strip("\t").split("\t") for r in _entry(head, "DATA_INFO").splitlines() if r.strip()]
    at = rows[0].index("Name") if rows and "Name" in rows[0] else 1
    return [r[at] for r in rows[1:] if len(r) > at], int(pixels[0]), int(pixels[1])


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def scan_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of all image files of a path (see decoded_pixels)."""
    return decoded_pixels(_binary(spark, path))


def _scanned_up(stated: bytes) -> bool:
    return _entry(stated.decode("latin-1").replace("\r\n", "\n"), "SCAN_DIR") == "up"


def _pixel_rows(held: list[tuple], sized: bool = False) -> pa.RecordBatch:
    """The pixels of pieces of images, in one batch: small files share a batch, as a batch costs more than a small file's rows."""
    files, names, nx, ny, up, lo, sizes, bodies = zip(*held, strict=True)
    piece, at = _within(sizes)
    at += np.array(lo)[piece]
    nx, ny = np.array(nx)[piece], np.array(ny)[piece]
    line, col = np.divmod(at, nx)
    side, row = np.divmod(line, ny)
    first = np.cumsum([0, *map(len, names[:-1])])  # of the names of all pieces
    channel = pa.array([c for x in names for c in x], pa.string()).take(pa.array(first[piece] + side // 2))
    columns = [pa.array(files, pa.string()).take(pa.array(piece)), channel, pa.array(["fwd", "bwd"]).take(pa.array(side % 2)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), _numbers(bodies, sizes)]
    called = ["file", "channel", "direction", "row", "col", "value"]
    if sized:
        columns += [pa.array(nx.astype(np.int32)), pa.array(ny.astype(np.int32)), pa.array(np.array(up)[piece])]
        called += ["nx", "ny", "up"]
    return pa.RecordBatch.from_arrays(columns, called)


def decoded_pixels(files: DataFrame, sized: bool = False) -> DataFrame:
    """(file, channel, direction, row, col, value) of scan images (file, content), in stored order (see mesh.flipped for the turn of lines).

    sized: with the columns and rows of each pixel's image and whether it was scanned upwards (nx, ny, up), as its head states them, so that pixels need not meet their headers."""

    def run(batches):
        held, n, seen, ways = [], 0, {}, {}
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = image_head(data, seen)
                if head is None:
                    continue
                names, nx, ny, body = head
                stated = data[: data.find(b":SCANIT_END:")] if sized else b""
                if stated not in ways:
                    if len(ways) >= _HEADS:
                        ways.clear()
                    ways[stated] = _scanned_up(stated)
                total = 2 * len(names) * nx * ny
                for lo in range(0, total, _CHUNK):
                    size = min(_CHUNK, total - lo)
                    held.append((file, names, nx, ny, ways[stated], lo, size, data[body + 4 * lo : body + 4 * (lo + size)]))
                    n += size
                    if n >= _CHUNK:
                        yield _pixel_rows(held, sized)
                        held, n = [], 0
        if held:
            yield _pixel_rows(held, sized)

    schema = "file string, channel string, direction string, row int, col int, value double"
    return files.select("file", "content").mapInArrow(run, schema + ", nx int, ny int, up boolean" if sized else schema)


def image_header_lines(spark: SparkSession, path: str, end: bytes = b":SCANIT_END:") -> DataFrame:
    """The header lines of files that continue in binary."""

    def run(batches):
        for batch in batches:
            heads = [d[: d.find(end) + len(end)].decode("latin-1") for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], ["file", "text"])

    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(run, "file string, text string")
    return L.split_lines(whole, "file", "text")


def point_spectra(lines: DataFrame) -> DataFrame:
    """(file, point, channel, value): the tab table after `[DATA]`; what is no number is null."""
    marks = lines.where(F.trim("line") == "[DATA]").groupBy("file").agg(F.min("ln").alias("_m"))
    body = lines.join(marks, "file").where((F.col("ln") > F.col("_m")) & (F.trim("line") != ""))
    names = body.where(F.col("ln") == F.col("_m") + 1).select("file", F.split("line", "\t").alias("names"))
    rows = body.where(F.col("ln") > F.col("_m") + 1).withColumn("point", F.row_number().over(Window.partitionBy("file").orderBy("ln")) - 1)
    cells = rows.join(names, "file").select("file", "point", F.explode(F.arrays_zip("names", F.split("line", "\t").alias("f"))).alias("c"))
    return cells.where("c.names is not null and trim(c.names) <> ''").select("file", "point", F.trim("c.names").alias("channel"), F.trim("c.f").try_cast("double").alias("value"))


def grid_head(data: bytes) -> tuple[dict, int] | None:
    """The layout of a spectrum grid, and where the numbers begin."""
    mark = data.find(b":HEADER_END:")
    if mark < 0:
        return None
    pairs = dict(line.split("=", 1) for line in data[:mark].decode("latin-1").splitlines() if "=" in line)
    get = lambda k: pairs.get(k, "").strip().strip('"')
    dim = re.fullmatch(r"(\d+)x(\d+)", get("Grid dim").replace(" ", ""))
    nx, ny = (int(dim[1]), int(dim[2])) if dim else (0, 0)
    names = [x for x in (get("Fixed parameters") + ";" + get("Experiment parameters")).split(";") if x]
    n_params = int(get("# Parameters (4 byte)") or len(names))
    channels = [x for x in get("Channels").split(";") if x]
    names = (names + [f"param_{i}" for i in range(len(names), n_params)])[:n_params]
    return {"nx": nx, "ny": ny, "names": names, "channels": channels, "points": int(get("Points") or 0)}, data.find(b"\n", mark) + 1


def grid_spectra(spark: SparkSession, path: str) -> DataFrame:
    """The spectra of all grid files of a path (see decoded_grids)."""
    return decoded_grids(_binary(spark, path))


def _spectrum_rows(held: list[tuple]) -> pa.RecordBatch:
    """The spectra of pieces of grids, in one batch: of each pixel its parameters, a list of one number each, and then its channels, a list of `points` numbers each."""
    files, nx, lo, pixels, params, channels, points, bodies = zip(*held, strict=True)
    n_params, names = np.array([len(x) for x in params]), [(*x, *y) for x, y in zip(params, channels, strict=True)]
    width = np.array([len(x) for x in names])
    piece, at = _within(width * np.array(pixels))
    pixel, nth = np.divmod(at, width[piece])
    pixel += np.array(lo)[piece]
    iy, ix = np.divmod(pixel, np.array(nx)[piece])
    first = np.cumsum(width) - width
    param = nth < n_params[piece]
    numbers = _numbers(bodies, [n * (len(x) + len(y) * k) for n, x, y, k in zip(pixels, params, channels, points, strict=True)])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(param, 1, np.array(points)[piece]))]).astype(np.int32)), numbers)
    called = pa.array([c for x in names for c in x], pa.string()).take(pa.array(first[piece] + nth))
    columns = [pa.array(files, pa.string()).take(pa.array(piece)), *(pa.array(c.astype(np.int32)) for c in (pixel, ix, iy)), pa.array(["channel", "param"]).take(pa.array(param.astype(np.int8))), called, lists]
    return pa.RecordBatch.from_arrays(columns, ["file", "pixel", "ix", "iy", "kind", "name", "values"])


def decoded_grids(files: DataFrame) -> DataFrame:
    """(file, pixel, ix, iy, kind, name, values) of spectrum grids (file, content): `param` rows hold one number, `channel` rows a spectrum.

    Surplus data are left out, missing ones null."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = grid_head(data)
                if head is None:
                    continue
                m, body = head
                each = len(m["names"]) + len(m["channels"]) * m["points"]
                for lo in range(0, m["nx"] * m["ny"], 1024):
                    pixels = min(1024, m["nx"] * m["ny"] - lo)
                    held.append((file, m["nx"], lo, pixels, m["names"], m["channels"], m["points"], data[body + 4 * lo * each : body + 4 * (lo + pixels) * each]))
                    n += pixels * (each + len(m["channels"]))
                    if n >= _CHUNK:
                        yield _spectrum_rows(held)
                        held, n = [], 0
        if held:
            yield _spectrum_rows(held)

    return files.select("file", "content").mapInArrow(run, "file string, pixel int, ix int, iy int, kind string, name string, values array<double>")
