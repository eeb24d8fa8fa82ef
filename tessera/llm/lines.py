"""Line dedup: sharded cuckoo filters backed by an exact table of references.

References (shard, k1, k2, doc_id) say which document holds which line key (a 128-bit hash of the key); counting them
gives the exact reference counts. A shard's cuckoo filter holds the keys with at least two references. Deduplication asks
the filters first and joins only possible repeats with the exact counts, which settle filter errors. Documents may be
inserted and deleted at any time: the counts of the keys concerned are taken again from the references, keys that reach or
leave a count of two enter or leave their filter, and the result is that of a build from the remaining documents.

Scale: keys are spread evenly over shards by their hash and appear once in the counts, so a filter build never sees a
hot group; counting is combined before the shuffle. A build takes SHARDS shards, doubled until they have SHARD_KEYS repeated keys each at most
on average; insertions that outgrow this double them again. References are asked where they are if all filters together have at most FILTER_BLOCK
bytes, which are broadcast; else they are shuffled once, narrow, by shard and a salt (about ASKED references for each, however often one line occurs), and
meet a copy of their shard's filter there. Either way they are read once. Texts are shuffled once, to meet the keys that they lose.

Edge cases: a null or empty text is one empty line. Rows with a null doc_id neither count nor lose lines. Repeated rows of a
doc_id are one document for counting. Ties do not occur: the smallest doc_id keeps a key. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, mixed, small_batches, table, written

LEAST_CHARS = 10
SHARDS, SHARD_KEYS = 64, 1 << 20
FILTER_BLOCK = 32 << 20
ASKED = 1 << 20
_STRIP = BLANKS.encode()
_KEYS = "shard int, k1 long, k2 long, doc_id long"


def _key(line: bytes) -> bytes | None:
    """The digest of a line's key; None for a key of fewer than LEAST_CHARS code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def references(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The distinct keys of each document."""

    def make(batches):
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text and doc is not None:
                    keys = {k for line in text.split(b"\n") if (k := _key(line))}
                    found += keys
                    ids += [doc] * len(keys)
            k = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            shard = (k[:, 0].view(np.uint64) >> np.uint64(32)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(ids, pa.int64())], ["shard", "k1", "k2", "doc_id"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(make, _KEYS)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; whole arrays of keys at a time."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        buckets = 1
        while buckets * 4 * 0.85 < n:
            buckets *= 2
        return cls(np.zeros((buckets, 4), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, 4).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _place(self, k1, k2) -> tuple[np.ndarray, np.ndarray]:
        return (k1.view(np.uint64) & np.uint64(len(self.slots) - 1)).astype(np.int64), (k2.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, bucket, print_) -> np.ndarray:
        return bucket ^ (mixed(print_.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if some key found no place: the filter must then be built anew, larger."""
        bucket, print_ = self._place(k1, k2)
        for turn in range(600):
            if not len(bucket):
                return True
            order = np.argsort(bucket, kind="stable")
            bucket, print_ = bucket[order], print_[order]
            first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            nth = np.arange(len(bucket)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            free = self.slots[bucket] == 0
            fits = nth < free.sum(1)
            where = np.argmax(np.cumsum(free, 1) == (nth + 1)[:, None], 1)
            self.slots[bucket[fits], where[fits]] = print_[fits]
            bucket, print_, first = bucket[~fits], print_[~fits], nth[~fits]
            if turn:  # the first of those left over in a bucket throws out one that is there
                kick = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else first[:0]
                slot = (mixed(bucket[kick].astype(np.uint64) + np.uint64(turn)) % np.uint64(4)).astype(np.int64)
                out = self.slots[bucket[kick], slot].copy()
                self.slots[bucket[kick], slot] = print_[kick]
                print_[kick] = out
            bucket = self._other(bucket, print_)
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for b, p in zip(*self._place(k1, k2), strict=True):
            for at in (b, int(self._other(np.array([b]), np.array([p]))[0])):
                hit = np.flatnonzero(self.slots[at] == p)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        bucket, print_ = self._place(k1, k2)
        return (self.slots[bucket] == print_[:, None]).any(1) | (self.slots[self._other(bucket, print_)] == print_[:, None]).any(1)


def _built(k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
    n = max(1, len(k1))
    while not (c := Cuckoo.for_keys(n)).insert(k1, k2):
        n *= 2
    return c


@dataclass
class LineIndex:
    """refs: (shard, k1, k2, doc_id); counts: (shard, k1, k2, n_docs, first_doc) of repeated keys; filters: (shard, filter); shards: how many."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _in_shards(df: DataFrame, shards: int) -> DataFrame:
    """df with its shard among that many, as references() has it."""
    return df.withColumn("shard", (F.shiftrightunsigned("k1", 32) % shards).cast("int"))


def _filters(counts: DataFrame) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [_built(pdf["k1"].to_numpy(), pdf["k2"].to_numpy()).to_bytes()]})

    return counts.select("shard", "k1", "k2").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _enough(n_keys: int, shards: int) -> int:
    while n_keys > shards * SHARD_KEYS:
        shards *= 2
    return shards


def built(docs: DataFrame, shards: int = SHARDS) -> LineIndex:
    """The index of all documents. shards: how many at least; doubled until a shard has SHARD_KEYS repeated keys or fewer on average."""
    refs = written(references(docs, shards).distinct(), "line-refs")
    counts = written(_counted(refs).where("n_docs > 1"), "line-counts")
    return _spread(LineIndex(refs, counts, counts, shards))


def _spread(index: LineIndex) -> LineIndex:
    """The index with its filters built from the counts, in as many shards as these need; the shard of a row is worked out where it is read."""
    shards = _enough(index.counts.count(), index.shards)
    refs, counts = (df if shards == index.shards else _in_shards(df, shards) for df in (index.refs, index.counts))
    return LineIndex(refs, counts, written(_filters(counts), "line-filters"), shards)


def _changed(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over refs, given the keys whose references changed."""
    keys = ["shard", "k1", "k2"]
    touched = touched.select(keys).distinct()
    again = written(_counted(refs.join(touched, keys, "left_semi")).where("n_docs > 1"), "line-again")
    counts = written(index.counts.join(touched, keys, "left_anti").unionByName(again), "line-counts")
    if _enough(counts.count(), index.shards) > index.shards:
        return _spread(LineIndex(refs, counts, counts, index.shards))
    before = index.counts.join(touched, keys, "left_semi").select(*keys)
    moves = again.select(keys).join(before, keys, "left_anti").withColumn("move", F.lit(1)).union(before.join(again, keys, "left_anti").withColumn("move", F.lit(-1)))

    def change(key, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        add, drop = moved[moved["move"] == 1], moved[moved["move"] == -1]
        c = Cuckoo.from_bytes(old["filter"].iloc[0]) if len(old) else Cuckoo.for_keys(max(1, len(add)))
        c.delete(drop["k1"].to_numpy(), drop["k2"].to_numpy())
        full = not c.insert(add["k1"].to_numpy(), add["k2"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "filter": [c.to_bytes()], "full": [full]})

    grown = written(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(change, "shard int, filter binary, full boolean"), "line-filters")
    full = grown.where("full").select("shard")
    anew = _filters(counts.join(full, "shard", "left_semi"))  # from the exact counts, larger
    return LineIndex(refs, counts, written(grown.where("not full").drop("full").unionByName(anew), "line-filters"), index.shards)


def inserted(index: LineIndex, docs: DataFrame, shards: int | None = None) -> LineIndex:
    """The index with these documents too. Its own shards hold; a number given must be theirs."""
    if shards not in (None, index.shards):
        raise ValueError(f"the index has {index.shards} shards")
    new = written(references(docs, index.shards).distinct().join(index.refs, ["shard", "k1", "k2", "doc_id"], "left_anti"), "line-new")
    return _changed(index, written(index.refs.unionByName(new), "line-refs"), new)


def deleted(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    gone = written(index.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(index.refs.columns), "line-gone")
    return _changed(index, written(index.refs.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(index.refs.columns), "line-refs"), gone)


def _held(cuckoos: dict[int, Cuckoo], batch: pa.RecordBatch) -> pa.RecordBatch:
    """The references of the batch (shard, k1, k2, ...) that the filters do not rule out."""
    shard, k1, k2 = (batch.column(c).to_numpy() for c in range(3))
    hit = np.zeros(len(shard), bool)
    for s in np.unique(shard):
        if s in cuckoos:
            mine = np.flatnonzero(shard == s)
            hit[mine] = cuckoos[s].holds(k1[mine], k2[mine])
    return batch.filter(pa.array(hit))


def possible_repeats(refs: DataFrame, filters: DataFrame) -> DataFrame:
    """The references that their shard's filter does not rule out."""
    refs = refs.select("shard", "k1", "k2", "doc_id")
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > FILTER_BLOCK:
        return _met(refs, filters)
    held = refs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})  # FILTER_BLOCK bytes at most

    def probe(batches):
        cuckoos = {s: Cuckoo.from_bytes(f) for s, f in held.value.items()}
        for batch in batches:
            yield _held(cuckoos, batch)

    return refs.mapInArrow(probe, _KEYS)


def _met(refs: DataFrame, filters: DataFrame) -> DataFrame:
    """possible_repeats without a broadcast: references and copies of the filters meet by shard and salt."""
    salts = refs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))  # one narrow row for each shard
    salts = F.broadcast(written(salts, "line-salts"))
    left = refs.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    right = filters.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")

    def ask(mine: pa.Table, filters: pa.Table) -> pa.Table:
        if not filters.num_rows:
            return mine.select(["shard", "k1", "k2", "doc_id"]).slice(0, 0)
        cuckoos = {filters.column("shard")[0].as_py(): Cuckoo.from_bytes(filters.column("filter")[0].as_py())}
        return pa.Table.from_batches([_held(cuckoos, b) for b in mine.select(["shard", "k1", "k2", "doc_id"]).to_batches()], mine.select(["shard", "k1", "k2", "doc_id"]).schema)

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(ask, _KEYS)


_KEPT = "doc_id long, n_lines long, n_dropped long, text string"


def _rewrite(batches):
    """Drops the lines with a listed key; (doc_id, number of lines, number dropped, kept text)."""
    for batch in batches:
        rows = []
        for doc, text, lose in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            if lose:
                drop = {int(x["k1"]).to_bytes(8, "little", signed=True) + int(x["k2"]).to_bytes(8, "little", signed=True) for x in lose}
                kept = [line for line in lines if _key(line) not in drop]
                rows.append((doc, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            else:
                rows.append((doc, len(lines), 0, text or b""))
        ids, n, k, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def without_repeats(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every repeated line is gone except in the smallest doc_id that holds it."""
    possible = possible_repeats(index.refs, index.filters)
    lose = possible.join(index.counts.drop("shard", "n_docs"), ["k1", "k2"]).where("doc_id <> first_doc").groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("lose"))
    return small_batches(docs.select("doc_id", "text").join(lose, "doc_id", "left")).mapInArrow(_rewrite, _KEPT)


def deduplicated(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return without_repeats(docs, built(docs, shards))


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(r.n >= 2 AND k.doc_id <> r.first_doc AND length(k.key) >= 10, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
