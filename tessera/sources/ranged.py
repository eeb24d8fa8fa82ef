"""Scan images and spectrum grids as Spark data sources that read byte ranges: what is asked for decides which bytes of a file are read.

`instrument.scan_pixels` and `grid_spectra` take whole files; here a file of any size is divided into splits of bytes, a task reads the file's header and then only those
samples of its split that are asked for by channel, direction and row (grids: pixel, kind and name). Files are opened with pyarrow.fs (local and mounted paths, hdfs, s3, gs); for other
file systems the whole-file readers stay. Rows are those of the whole-file readers.

The selection is given by arguments and not by pushed filters: Spark 4.1 keeps the filters last pushed into a Python source for the DataFrame's later plans, so that a second, different `where` on
one DataFrame loses rows (tests/test_ranged.py uses one DataFrame with many filters)."""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import instrument

SPLIT = 64 << 20  # bytes of a task
GAP = 4096  # wanted ranges of a grid file that are as near as this are read at once
_HEAD, _LONGEST_HEAD = 1 << 14, 1 << 26  # a file without its end mark in the first 64 MB is of another kind
_SAMPLES = 1 << 16


class Wanted:
    """What is asked for: sets of strings (None: all), a span of whole numbers (first, one past the last)."""

    def __init__(self, sets: dict[str, list[str] | None], span: list[int] | None) -> None:
        self.sets = {c: None if v is None else frozenset(v) for c, v in sets.items()}
        self.low, self.high = span or (0, 1 << 62)

    def has(self, column: str, value: str) -> bool:
        return self.sets[column] is None or value in self.sets[column]

    def span(self, n: int) -> tuple[int, int]:
        """Of the numbers below n, the first and one past the last."""
        return max(self.low, 0), min(self.high, n)


class Splits(InputPartition):
    """Pieces of files: (path, name, first byte, one past the last or None for the rest)."""

    def __init__(self, pieces: list[tuple[str, str, int, int | None]]) -> None:
        super().__init__(None)
        self.pieces = pieces


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what names of its files begin with."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:"), "file:"
    scheme, rest = path.split("://", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), rest, "file:"
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, inner, f"{scheme}://" + (rest.split("/", 1)[0] if inner.startswith("/") else "")


class RangeReader(DataSourceReader):
    """Splits by bytes; small files share a task."""

    head = None  # bytes of a file's beginning to its layout

    def __init__(self, path: str, split: int, wanted: Wanted) -> None:
        self.path, self.split, self.wanted = path, split, wanted

    def partitions(self) -> list[Splits]:
        """From names and sizes alone; headers are read by the tasks."""
        system, inner, prefix = _system(self.path)
        folder, pattern = (posixpath.dirname(inner), posixpath.basename(inner)) if "*" in inner else (inner, "*")
        info = system.get_file_info(folder)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
        groups, room = [], 0
        for f in sorted((f for f in files if info.is_file or not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            for low in range(0, max(f.size, 1), self.split):
                size = min(self.split, max(f.size - low, 1)) + (_HEAD << 2)  # the cost of opening it
                if not groups or size > room:
                    groups.append([])
                    room = self.split + (_HEAD << 2)
                room -= size
                groups[-1].append((f.path, prefix + f.path, low, low + self.split if low + self.split < f.size else None))
        return [Splits(g) for g in groups]

    def open(self, path: str):
        return _system(self.path)[0].open_input_file(path)

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for path, name, low, high in partition.pieces:
            with self.open(path) as file:
                size, data = _HEAD, file.read_at(_HEAD, 0)
                layout = type(self).head(data)
                while (layout is None or layout[-1] > len(data) - 2 or layout[-1] <= 2) and len(data) == size < _LONGEST_HEAD:  # the header is longer
                    size *= 4
                    data = file.read_at(size, 0)
                    layout = type(self).head(data)
                if layout is not None:
                    yield from self.rows(file, name, layout, low, high)


def _read(file, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n numbers from a byte on, and which are there."""
    return instrument._padded(file.read_at(4 * n, first) if first < file.size() else b"", n)


class ImageReader(RangeReader):
    head = staticmethod(instrument.image_head)

    def rows(self, file, name: str, layout, low: int, high: int | None):
        names, nx, ny, body = layout
        total = 2 * len(names) * nx * ny
        first, last = max(0, -(-(low - body) // 4)), total if high is None else min(total, max(0, -(-(high - body) // 4)))  # samples that begin in the split
        r0, r1 = self.wanted.span(ny)
        for c, channel in enumerate(names):
            for d, direction in enumerate(("fwd", "bwd")):
                if not (self.wanted.has("channel", channel) and self.wanted.has("direction", direction)):
                    continue
                base = (2 * c + d) * ny * nx
                for lo in range(max(first, base + r0 * nx), min(last, base + r1 * nx), _SAMPLES):
                    n = min(_SAMPLES, min(last, base + r1 * nx) - lo)
                    v, t = _read(file, body + 4 * lo, n)
                    at = np.arange(lo - base, lo - base + n)
                    cells = [pa.array((at // nx).astype(np.int32)), pa.array((at % nx).astype(np.int32)), pa.array(v, mask=~t)]
                    yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.string()) for x in (name, channel, direction)] + cells, ["file", "channel", "direction", "row", "col", "value"])


class GridReader(RangeReader):
    head = staticmethod(instrument.grid_head)

    def rows(self, file, name: str, layout, low: int, high: int | None):
        m, body = layout
        p, points = len(m["names"]), m["points"]
        each = p + len(m["channels"]) * points
        fields = [("param", x, k, 1) for k, x in enumerate(m["names"])] + [("channel", x, p + k * points, points) for k, x in enumerate(m["channels"])]
        fields = [f for f in fields if self.wanted.has("kind", f[0]) and self.wanted.has("name", f[1])]
        total, step = m["nx"] * m["ny"], max(4 * each, 1)
        first, last = max(0, -(-(low - body) // step)), total if high is None else min(total, max(0, -(-(high - body) // step)))  # pixels that begin in the split
        start, stop = self.wanted.span(total)
        if not fields:
            return
        runs: list[list[int]] = []  # wanted places of a pixel, first and one past the last; near ones together
        for _, _, lo, n in fields:
            if runs and 4 * (lo - runs[-1][1]) <= GAP:
                runs[-1][1] = lo + n
            else:
                runs.append([lo, lo + n])
        if len(runs) == 1 and step - 4 * (runs[0][1] - runs[0][0]) <= GAP:
            runs = [[0, each]]  # pixels follow one another
        whole = runs == [[0, each]]
        places = np.concatenate([np.arange(lo, lo + n) for _, _, lo, n in fields])
        most, end = max(1, min(256, (4 << 20) // max(each, 1))), min(last, stop)
        for pixel in range(max(first, start), end, most):
            count = min(most, end - pixel)
            v, t = np.zeros((count, each)), np.zeros((count, each), bool)
            reads = [(0, count, 0, each)] if whole else [(k, 1, lo, hi) for k in range(count) for lo, hi in runs]
            for k, rows, lo, hi in reads:
                got = _read(file, body + step * (pixel + k) + 4 * lo, rows * (hi - lo))
                v[k : k + rows, lo:hi], t[k : k + rows, lo:hi] = (x.reshape(rows, hi - lo) for x in got)
            yield self.batch(name, m, np.arange(pixel, pixel + count), fields, v[:, places], t[:, places])

    @staticmethod
    def batch(name: str, m: dict, pixels: np.ndarray, fields: list, v: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        n = len(pixels) * len(fields)
        ends = np.concatenate([[0], np.cumsum([f[3] for f in fields] * len(pixels))]).astype(np.int32)
        at = np.repeat(pixels, len(fields))
        numbers = [pa.array(c.astype(np.int32)) for c in (at, at % m["nx"], at // m["nx"])]
        texts = [pa.array([f[k] for f in fields] * len(pixels), pa.string()) for k in (0, 1)]
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(v.reshape(-1), mask=~t.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *numbers, *texts, values], ["file", "pixel", "ix", "iy", "kind", "name", "values"])


def _asked(options: dict[str, str]) -> tuple[str, int, Wanted]:
    return options["path"], int(options["split"]), Wanted(json.loads(options["sets"]), json.loads(options["span"]))


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_images"

    def schema(self) -> str:
        return "file string, channel string, direction string, row int, col int, value double"

    def reader(self, schema) -> ImageReader:
        return ImageReader(*_asked(self.options))


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_grids"

    def schema(self) -> str:
        return "file string, pixel int, ix int, iy int, kind string, name string, values array<double>"

    def reader(self, schema) -> GridReader:
        return GridReader(*_asked(self.options))


def _load(spark: SparkSession, source: type[DataSource], path: str, split: int, sets: dict[str, list[str] | None], span: tuple[int, int] | None) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(split=split, sets=json.dumps(sets), span=json.dumps(span)).load(path)


def scan_pixels(spark: SparkSession, path: str, channels: list[str] | None = None, directions: list[str] | None = None, rows: tuple[int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """instrument.scan_pixels of a file, folder or pattern by byte ranges: all pixels, or those of some channels, directions ("fwd", "bwd") and rows (first, one past the last)."""
    return _load(spark, ImageSource, path, split, {"channel": channels, "direction": directions}, rows)


def grid_spectra(spark: SparkSession, path: str, kinds: list[str] | None = None, names: list[str] | None = None, pixels: tuple[int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """instrument.grid_spectra of a file, folder or pattern by byte ranges: all spectra, or those of some kinds ("param", "channel"), names and pixels (first, one past the last)."""
    return _load(spark, GridSource, path, split, {"kind": kinds, "name": names}, pixels)
