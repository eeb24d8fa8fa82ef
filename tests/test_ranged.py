"""Byte-range sources against the readers of whole files."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.sources import instrument, ranged


def image(nx, ny, channels, short=0, pad=0):
    head = f":SCAN_PIXELS:\n {nx} {ny}\n:COMMENT:\n{'x' * pad}\n:DATA_INFO:\n\tChannel\tName\tUnit\n" + "".join(f"\t{k}\t{c}\tm\n" for k, c in enumerate(channels)) + ":SCANIT_END:\n\n\n"
    v = np.arange(2 * len(channels) * nx * ny, dtype=float)
    v[3] = np.nan
    return head.encode() + b"\x1a\x04" + v.astype(">f4").tobytes()[: -4 * short or None]


def spectra(nx, ny, points, channels, short=0):
    head = f'Grid dim="{nx} x {ny}"\r\nPoints={points}\r\nChannels={";".join(channels)}\r\n# Parameters (4 byte)=3\r\nFixed parameters=s\r\nExperiment parameters=x;y\r\n:HEADER_END:\r\n'
    return head.encode() + np.arange(nx * ny * (3 + points * len(channels)), dtype=">f4").tobytes()[: -4 * short or None]


@pytest.fixture
def images(tmp_path):
    for name, data in (("a", image(7, 5, ["Z", "I", "Q"])), ("cut", image(7, 5, ["Z", "I"], short=40)), ("long", image(4, 3, ["Z"], pad=40_000)), ("other", b"no image"), ("empty", b"")):
        (tmp_path / f"{name}.sxm").write_bytes(data)
    return str(tmp_path)


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(repr(r) for r in got.select(cols).collect()) == sorted(repr(r) for r in want.select(cols).collect())


@pytest.mark.parametrize("split", [700, 1 << 26])
def test_images_equal_whole_files(spark, images, split):
    got, want = ranged.scan_pixels(spark, images, split=split), instrument.scan_pixels(spark, images)
    assert want.count() == 210 + 140 + 24
    same(got, want)
    for f in ("channel = 'I' and direction = 'bwd'", "row >= 2 and row < 4", "channel in ('Q', 'none') or row = 0"):  # one DataFrame, several filters
        same(got.where(f), want.where(f))
    same(got.where("row = 1").unionByName(got.where("channel = 'I'")), want.where("row = 1").unionByName(want.where("channel = 'I'")))
    for asked, f in (({"channels": ["I", "x"], "directions": ["bwd"]}, "channel in ('I', 'x') and direction = 'bwd'"), ({"rows": (2, 4)}, "row in (2, 3)"), ({"channels": []}, "false"), ({"rows": (3, 99)}, "row >= 3"), ({"rows": (4, 4)}, "false")):
        same(ranged.scan_pixels(spark, images, split=split, **asked), want.where(f))


@pytest.mark.parametrize("split", [500, 1 << 26])
def test_grids_equal_whole_files(spark, tmp_path, split):
    (tmp_path / "a.3ds").write_bytes(spectra(3, 4, 5, ["I", "V"]))
    (tmp_path / "cut.3ds").write_bytes(spectra(2, 2, 5, ["I"], short=11))
    (tmp_path / "wide.3ds").write_bytes(spectra(2, 1, 3000, ["I", "V", "W"]))
    (tmp_path / "none.3ds").write_bytes(spectra(2, 2, 0, ["I"]))
    got, want = ranged.grid_spectra(spark, f"{tmp_path}/*.3ds", split=split), instrument.grid_spectra(spark, f"{tmp_path}/*.3ds")
    same(got, want)
    for asked, f in (({"names": ["V"]}, "name = 'V'"), ({"kinds": ["param"], "pixels": (1, 9)}, "kind = 'param' and pixel >= 1 and pixel < 9"), ({"names": ["x", "W"]}, "name in ('x', 'W')"), ({"pixels": (3, 4)}, "pixel = 3"), ({"names": ["none"]}, "false")):
        same(ranged.grid_spectra(spark, f"{tmp_path}/*.3ds", split=split, **asked), want.where(f))


class Counting:
    """A file that counts the bytes read of it."""

    def __init__(self, file, counts):
        self.file, self.counts = file, counts

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        data = self.file.read_at(n, at)
        self.counts.append(len(data))
        return data


def bytes_read(reader, monkeypatch):
    counts, plain = [], type(reader).open
    monkeypatch.setattr(type(reader), "open", lambda self, path: Counting(plain(self, path), counts))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    monkeypatch.undo()
    return sum(counts), rows


def test_a_channel_of_ten_reads_a_tenth(tmp_path, monkeypatch):
    path = tmp_path / "big.sxm"
    path.write_bytes(image(256, 256, [f"c{k}" for k in range(10)]))
    size = path.stat().st_size
    read = lambda span, **sets: bytes_read(ranged.ImageReader(str(path), 1 << 20, ranged.Wanted({"channel": None, "direction": None} | sets, span)), monkeypatch)
    every, rows = read(None)
    assert rows == 20 * 256 * 256 and every < size + 10 * ranged._HEAD
    some, rows = read(None, channel=["c3"])
    assert rows == 2 * 256 * 256 and some < size / 10 + 10 * ranged._HEAD
    some, rows = read((16, 32), channel=["c3"], direction=["fwd"])
    assert rows == 16 * 256 and some == 16 * 256 * 4 + 6 * ranged._HEAD  # six splits read the header
    grid = tmp_path / "big.3ds"
    grid.write_bytes(spectra(4, 4, 4096, [f"c{k}" for k in range(10)]))
    size = grid.stat().st_size
    read = lambda span, **sets: bytes_read(ranged.GridReader(str(grid), 1 << 20, ranged.Wanted({"kind": None, "name": None} | sets, span)), monkeypatch)
    some, rows = read(None, name=["c7"])
    assert rows == 16 and some < size / 10 + 4 * ranged._HEAD
    some, rows = read((5, 6))
    assert rows == 13 and some < size / 16 + 4 * ranged._HEAD


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        ranged.scan_pixels(spark, str(tmp_path / "nowhere")).collect()


def test_small_files_share_a_batch(spark):
    """300 small files give one batch of rows, and each file keeps its own shape, heads and gaps."""
    from tessera.sources import instrument

    class Files:  # stands for a DataFrame: what the decoder yields for one task
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run


    image = lambda n, cut: (f":SCAN_PIXELS:\n {n} 1\n:DATA_INFO:\n\tChannel\tName\n\t14\tZ{n}\n:SCANIT_END:\n\n\n".encode() + b"\x1a\x04" + np.arange(2 * n).astype(">f4").tobytes())[: -cut or None]
    grid = lambda n: f'Grid dim="{n} x 1"\r\nPoints={n}\r\nChannels=a;b\r\nFixed parameters=X\r\n:HEADER_END:\r\n'.encode() + np.arange(n * (1 + 2 * n) - 1).astype(">f4").tobytes()
    sizes = [1 + k % 3 for k in range(300)]
    for make, decode, kept in ((lambda n: image(n, 5), instrument.decoded_pixels, "value"), (grid, instrument.decoded_grids, "values")):
        files = spark.createDataFrame([(str(k), bytearray(make(n))) for k, n in enumerate(sizes)], "file string, content binary").coalesce(1)
        got = decode(files)
        rows = got.collect()
        batch = pa.RecordBatch.from_pydict({"file": [str(k) for k in range(300)], "content": [make(n) for n in sizes]})
        (whole,) = decode(Files())(iter([batch]))
        assert whole.num_rows == len(rows)
        for k in (0, 1, 2, 299):
            mine, n = [r for r in rows if r.file == str(k)], sizes[k]
            if kept == "value":
                assert [(r.channel, r.direction, r.row, r.col, r.value) for r in mine] == [(f"Z{n}", d, 0, c, None if a * n + c >= 2 * n - 2 else a * n + c) for a, d in enumerate(("fwd", "bwd")) for c in range(n)]
            else:
                flat = [None if x == n * (1 + 2 * n) - 1 else x for x in range(n * (1 + 2 * n))]
                want = [(p, kind, name, flat[p * (1 + 2 * n) + a : p * (1 + 2 * n) + b]) for p in range(n) for kind, name, a, b in (("param", "X", 0, 1), ("channel", "a", 1, 1 + n), ("channel", "b", 1 + n, 1 + 2 * n))]
                assert [(r.pixel, r.kind, r["name"], r["values"]) for r in mine] == want
