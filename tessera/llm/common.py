"""What the training-data operators share: written tables, column names, and word hashing on byte arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of every operator here: the ASCII blanks. A word is a longest run of other characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-tessera-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return _own_folder[0]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table (with the writer's options) in the shared folder: its lineage ends there, and a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that no later read needs."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 digits of the text's hash and 16 of the id (`-` for a null one): equal for repeated rows only; copies of a text are neighbours."""
    return F.concat(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16), F.coalesce(F.lpad(F.hex(doc_id), 16, "0"), F.lit("-" * 16)))


def small(df: DataFrame, most: int = 1 << 22) -> DataFrame:
    """df marked for broadcast if it is counted to have at most `most` (narrow) rows; beyond that Spark's shuffle joins take it."""
    return F.broadcast(df) if df.count() <= most else df


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after limiting the session's Arrow batches to TEXT_BATCH bytes: by default a task holds 64 MB of texts several times over."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH, str(1 << 30)).strip().lower().removesuffix("b")
    if not now.isdigit() or int(now) > TEXT_BATCH:
        conf.set(_BATCH, str(TEXT_BATCH))
    return df


def swept(held: list):
    """The values of broadcasts, one after another. Of several, a worker lets go of each before it reads the next from its local file."""
    for b in held:
        yield b.value
        if len(held) > 1 and getattr(b, "_path", None):
            vars(b).pop("_value", None)


def _units(batches, at: int, most: int):
    """(batches, texts) of consecutive batches with about most bytes of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        mine = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
        held.append(batch)
        texts += mine
        size += sum(map(len, mine))
        if size >= most:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def with_columns(docs: DataFrame, text_col: str, ddl: str, make, unit: int | None = None) -> DataFrame:
    """docs with the columns of ddl, which make() computes from the text, batch by batch and without a shuffle.

    make() returns a function from a list of byte strings (null as empty) to arrays. Columns of docs with the same names give way.
    It is called on blocks of TEXT_BLOCK bytes, or on whole batches of unit bytes together where each call has work that does not depend on the texts."""
    new = StructType.fromDDL(ddl)
    docs = docs.drop(*new.names)
    at = docs.columns.index(text_col)

    def run(batches):
        compute = make()
        for held, texts in _units(batches, at, unit) if unit else ():
            columns, first = compute(texts), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(c.slice(first, batch.num_rows) for c in columns)], [*batch.schema.names, *new.names])
                first += batch.num_rows
        for batch in batches:  # none are left after units
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *compute(texts[lo:hi])], [*batch.schema.names, *new.names])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *new.fields]))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of text that a kernel works on at once: its arrays are several times as large, and a Python worker keeps what it once took.
TEXT_BLOCK = 1 << 19


def in_blocks(sizes: list[int], most: int):
    """(start, end) of consecutive runs whose sizes add up to about most; a larger single item is its own run."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# --- words as 64-bit hashes, over the bytes of many texts at once -------------------------------------------------

_STEP = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Hashes of the words of byte strings. One instance serves a whole task."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_STEP + 1)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.value = lower.astype(_U) + _U(1)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def _of_block(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = self.blank[b]
        edge = np.flatnonzero(np.diff(gap))
        starts, ends = edge[gap[edge]] + 1, edge[~gap[edge]] + 1
        if not gap[0]:
            starts = np.concatenate(([0], starts))
        if not gap[-1]:
            ends = np.concatenate((ends, [len(b)]))
        if not len(starts):
            return np.zeros(0, _U), starts
        if len(b) >= len(self.up):
            self.up, self.down = _powers(len(b) + 1)
        sums = np.empty(len(b) + 1, _U)
        sums[0] = 0
        np.cumsum(self.value[b] * self.up[: len(b)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(_U)), starts

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, byte offset) of each word, A-Z lower-cased. Works through blocks cut at blanks: memory stays near that of one block."""
        b = np.frombuffer(data, np.uint8)
        hashes, starts, at = [], [], 0
        while at < len(b):
            end = min(len(b), at + _STEP)
            if end < len(b):
                cut = np.flatnonzero(self.blank[b[at:end]])
                while not len(cut) and end < len(b):  # a word longer than a block
                    end = min(len(b), end + _STEP)
                    cut = np.flatnonzero(self.blank[b[at:end]])
                if end < len(b):
                    end = at + int(cut[-1]) + 1
            h, s = self._of_block(b[at:end])
            hashes.append(h)
            starts.append(s + at)
            at = end
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, _U), np.zeros(0, np.int64))

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
        hashes, starts = self.of(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


_TIMES = tuple(int(x) for x in mixed(np.arange(1, 9, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash of each run of n words, in order; of the whole sequence where it is shorter; none without words."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, _U)
    total = np.full(len(words) - k + 1, k, _U)
    for i in range(k):
        total += mixed(words[i : len(words) - k + 1 + i] ^ _U(_TIMES[i])) * _U(_TIMES[i])
    return mixed(total)
