"""Packing: whole documents into sequences of a fixed size, by shortest-pack-first over the histogram of their lengths.

A document is encoded by a public byte-level vocabulary and closed by id 0. What fills whole sequences is cut off first; the rest (fewer
than `size` ids) is one item of a histogram of at most size - 1 lengths. The histogram is packed on the driver: lengths go longest first,
each to the shortest open pack, and packs are kept as patterns with counts, so that the work depends on the number of lengths, not of
documents. A pattern's slot names a length and a range of ranks, and patterns meet documents by (length, rank). If the patterns are padded
more than `padding`, items of the shortest packs are cut to fill the holes of the others.

A sequence is padded to `size` unless its length is a power of two: `padded_to` says to what.

Scale: texts are encoded once; the encoded ids stay in a table of the shared folder. A task numbers its own documents by length while it
encodes them, so ranks need sums over (task, length) only; those are broadcast if counted to be few, else joined by shuffle. No text
or id list is shuffled or sorted in the first case. The driver sees one row a length.

Edge cases: a null or empty text is the closing id alone. Repeated rows and null ids are documents like others. Very long texts are encoded in
slices, cut where the vocabulary's own splitting ends a piece anyway (before a blank that follows a printable ASCII character); one
without such a place is encoded whole. Other columns, whatever their names, are left out. Ties between packs of equal length go to the older pack.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BLOCK, in_blocks, small, small_batches, table, written
from .tokens import PATTERN

VOCABULARY = "byte_bpe_50k.json"
#: Ids of a sequence, and the id that closes a document.
SIZE, CLOSING = 1024, 0
#: Share of padding beyond which items are cut to fill holes, and the smallest hole that an item is cut for.
PADDING, HOLE = 0.005, 16
_RANK = 40


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's bytes (about 2 MB; they travel with the tasks), by default of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Ids of texts as bytes (unsigned 32-bit, little-endian), those that `tokenizers` gives with the vocabulary file.

    Its merges are applied by `tiktoken`, several times faster, where both must split a text alike: in texts of ASCII, Latin letters and common punctuation.
    All other texts, and those that spell the special token, go through `tokenizers` itself."""

    _OTHER = re.compile("[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u20ac]")
    _CUT = re.compile(r"(?<=[!-~])(?=[ \n])")

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(vocabulary)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # A byte-level name spells a byte that is not a printable Latin character by one beyond U+00FF, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(map(byte.__getitem__, name)): i for name, i in self.model.get_vocab(with_added_tokens=False).items() if name not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        if self._OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def slices(self, text: str):
        """Parts of about TEXT_BLOCK characters whose ids add up to the text's."""
        at = 0
        while len(text) - at > TEXT_BLOCK and (cut := self._CUT.search(text, at + TEXT_BLOCK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def of(self, text: str) -> bytes:
        return self._ids(text) if len(text) <= TEXT_BLOCK else b"".join(map(self._ids, self.slices(text)))


def _encoding(held, size: int, closing: int):
    end = int(closing).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), Encoder(held.value)
        whole, seen = 0, np.zeros(size, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
                ids = [encoder.of(t) + end for t in texts[lo:hi]]
                tokens = np.array([len(x) // 4 for x in ids], np.int64)
                full, rest, nth = tokens // size, tokens % size, np.empty(hi - lo, np.int64)
                for i, r in enumerate(rest.tolist()):
                    nth[i] = seen[r]
                    seen[r] += 1
                before = whole + np.cumsum(full) - full
                whole += int(full.sum())
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(tokens), pa.array(ids, pa.binary()), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before), pa.array(rest.astype(np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "ids", "part", "nth_full", "rest", "nth_rest"])

    return run


def encoded(docs: DataFrame, size: int = SIZE, path: str | None = None, closing: int = CLOSING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, doc_tokens, ids (bytes), and within its task (part) the number of whole sequences before it (nth_full) and of
    documents before it whose last, shorter piece is as long (rest, nth_rest)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(docs).mapInArrow(_encoding(held, size, closing), "doc_id long, doc_tokens long, ids binary, part int, nth_full long, rest int, nth_rest long")


# --- patterns: (fill, count, slots); a slot is (length of the item it comes from, first rank, start in the item, length here, offset) ----------


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def padded_to(fill: int, size: int) -> int:
    return fill if _power_of_two(fill) else size


class Patterns:
    """Packs as patterns with counts. An item is `n` pieces of one length, cut from documents of consecutive ranks."""

    def __init__(self, size: int) -> None:
        self.size, self.serial, self.open, self.full = size, 0, [], []

    def push(self, fill: int, count: int, slots: list[tuple]) -> None:
        if fill == self.size:
            self.full.append((fill, count, slots))
        elif count:
            heapq.heappush(self.open, (fill, self.serial, count, slots))
            self.serial += 1

    @staticmethod
    def later(slots: list[tuple], by: int) -> list[tuple]:
        return [(rest, rank + by, *more) for rest, rank, *more in slots]

    def add(self, fill: int, count: int, slots: list[tuple], n: int, item: tuple, length: int) -> int:
        """The first n of count packs take a piece each; how many did."""
        m = min(n, count)
        if m < count:
            self.push(fill, count - m, self.later(slots, m))
        rest, rank, start = item
        self.push(fill + length, m, [*slots, (rest, rank, start, length, fill)])
        return m

    def place(self, length: int, n: int, item: tuple) -> None:
        """n pieces, each to the shortest pack; a pack that is opened takes equal ones until another is shorter or it is full."""
        rest, rank, start = item
        while n:
            if self.open and self.open[0][0] + length <= self.size:
                fill, _, count, slots = heapq.heappop(self.open)
                done = self.add(fill, count, slots, n, (rest, rank, start), length)
            else:
                each = min(n, self.size // length)
                count = n // each
                done = each * count
                self.push(each * length, count, [(rest, rank + k * count, start, length, k * length) for k in range(each)])
            rank, n = rank + done, n - done

    def waste(self) -> int:
        return sum(count * (padded_to(fill, self.size) - fill) for fill, _, count, _ in self.open)

    def top_up(self) -> bool:
        """Some of the shortest packs are taken apart and their pieces cut to fill the holes of the others, smallest hole first. False if nothing can be filled."""
        fill, _, count, slots = heapq.heappop(self.open)
        if count > 1:  # a part of these packs fills the others, too
            part = max(1, count * (self.size - fill) // self.size)
            self.push(fill, count - part, self.later(slots, part))
            count = part
        holes = sorted((self.size - f, k, c, s) for f, k, c, s in self.open if self.size - f >= HOLE and not _power_of_two(f))
        if not holes:
            self.push(fill, count, slots)
            return False
        self.open = [x for x in self.open if self.size - x[0] < HOLE or _power_of_two(x[0])]
        heapq.heapify(self.open)
        pieces = [(length, count, (rest, rank, start)) for rest, rank, start, length, _ in slots]
        left = []
        while pieces:
            length, n, (rest, rank, start) = pieces.pop()
            if not holes:
                left.append((length, n, (rest, rank, start)))
                continue
            hole, k, have, into = holes.pop(0)
            m, part = min(n, have), min(hole, length)
            if m < have:
                holes.insert(0, (hole, k, have - m, self.later(into, m)))
            if m < n:
                pieces.append((length, n - m, (rest, rank + m, start)))
            if part < length:
                pieces.append((length - part, m, (rest, rank, start + part)))
            done = [*into, (rest, rank, start, part, self.size - hole)]
            if hole - part >= HOLE:
                holes = sorted([*holes, (hole - part, k, m, done)], key=lambda h: h[:2])
            else:
                self.push(self.size - hole + part, m, done)
        for hole, _, have, into in holes:
            self.push(self.size - hole, have, into)
        for length, n, item in sorted(left, key=lambda x: -x[0]):
            self.place(length, n, item)
        return True


def packed_histogram(counts: dict[int, int], size: int = SIZE, padding: float = PADDING) -> list[tuple]:
    """(fill, count, slots) of all packs of the items counted by length."""
    packs = Patterns(size)
    for length in sorted((x for x in counts if x > 0), reverse=True):
        packs.place(length, counts[length], (length, 0, 0))
    total = sum(length * n for length, n in counts.items())
    best = packs.waste() + 1
    for _ in range(64):
        now = packs.waste()
        if now <= padding * total or now >= best or not packs.open:
            break
        best = now
        if not packs.top_up():
            break
    return packs.full + [(fill, count, slots) for fill, _, count, slots in packs.open]


def _layers(packs: list[tuple], size: int) -> list[dict[str, np.ndarray]]:
    """The slots as sorted arrays; in a layer no two slots meet the same document. Layer k holds the k-th piece of each."""
    layers: dict[int, list[tuple]] = {}
    base = 0
    by_item: list[tuple] = []
    for fill, count, slots in packs:
        for rest, rank, start, length, offset in slots:
            by_item.append((rest, rank, start, length, count, base, offset, padded_to(fill, size)))
        base += count
    marks: dict[int, list[int]] = {}
    for s in by_item:
        marks.setdefault(s[0], []).extend((s[1], s[1] + s[4]))
    marks = {r: sorted(set(x)) for r, x in marks.items()}
    for rest, rank, start, length, count, first, offset, to in sorted(by_item, key=lambda s: s[2]):  # cut where other pieces of the same documents begin or end
        points = marks[rest]
        lo, hi = np.searchsorted(points, (rank, rank + count))
        for a, b in zip(points[lo:hi], points[lo + 1 : hi + 1], strict=True):
            layers.setdefault((rest, a), []).append((rest << _RANK | a, b - a, start, length, first + a - rank, offset, to))
    depth = max((len(x) for x in layers.values()), default=0)
    names = ("key", "count", "start", "length", "sequence", "offset", "padded_to")
    out = []
    for k in range(depth):
        rows = sorted(x[k] for x in layers.values() if len(x) > k)
        out.append({n: np.array(c, np.int64) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    return out


def _cutting(held, size: int):
    def run(batches):
        layers = held.value
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("doc_tokens", "part", "nth_full", "rest", "rank")}
            n, full = batch.num_rows, col["doc_tokens"] // size
            row = np.repeat(np.arange(n), full)
            j = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            same = lambda v: np.full(len(row), v, np.int64)  # noqa: E731, B023
            found = [(row, j * size, same(size), ((col["part"][row] + 1) << _RANK) + col["nth_full"][row] + j, same(0), same(size))]
            key, has = (col["rest"] << _RANK) + col["rank"], col["rest"] > 0
            for x in layers:
                at = np.maximum(np.searchsorted(x["key"], key, "right") - 1, 0)
                i = np.flatnonzero(has & (key >= x["key"][at]) & (key < x["key"][at] + x["count"][at]))
                at = at[i]
                found.append((i, full[i] * size + x["start"][at], x["length"][at], x["sequence"][at] + key[i] - x["key"][at], x["offset"][at], x["padded_to"][at]))
            row, start, length, sequence, offset, to = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, row))
            row, start, length, sequence, offset, to = (c[order] for c in (row, start, length, sequence, offset, to))
            data = b"".join(batch.column("ids").to_pylist())
            ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)  # pieces follow each other as the documents do
            ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length)), ids, *map(pa.array, (col["doc_tokens"][row], sequence, offset, to))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    return run


def packed(docs: DataFrame, size: int = SIZE, padding: float = PADDING, path: str | None = None, closing: int = CLOSING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: doc_id, start, length, ids (bytes), doc_tokens, sequence_id, offset, padded_to."""
    spark = docs.sparkSession
    enc = written(encoded(docs, size, path, closing, id_col, text_col), "encoded", compression="zstd")
    counts = written(enc.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = {r.rest: r.n for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer than `size` rows
    held = spark.sparkContext.broadcast(_layers(packed_histogram(hist, size, padding), size))
    ranked = enc.join(small(counts.select("part", "rest", before.alias("before"))), ["part", "rest"]).withColumn("rank", F.col("before") + F.col("nth_rest")).drop("before", "nth_rest")
    return small_batches(ranked).mapInArrow(_cutting(held, size), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Per sequence its ids (bytes, unpadded), the number of its pieces and what it is padded to. A group holds at most `size` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.count(F.lit(1)).alias("pieces"), F.max("padded_to").alias("padded_to")
    )


def padding_share(pieces: DataFrame) -> DataFrame:
    """One row: ids, padding, and sequences."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max("padded_to").alias("to"))
    return each.agg(F.sum("ids").alias("ids"), F.sum(F.col("to") - F.col("ids")).alias("padding"), F.count(F.lit(1)).alias("sequences"))


def op13_packed_sequences(spark, sf_dir) -> DataFrame:
    found = packed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")
