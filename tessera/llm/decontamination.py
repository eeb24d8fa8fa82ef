"""Benchmark decontamination: a BM25 inverted index of test items, read with block-max bounds by every training passage.

An item's own BM25 score against itself is 1; a passage (PASSAGE words, half overlapping with the next) retrieves every item that it
scores at least RETRIEVE against. Posting lists are sorted by item, with their largest weight as a whole and in each block of items.
Retrieval is block-max WAND: cursors on the lists of a passage's words, in the order of the items they stand at; the pivot is the first item
where the running sum of list maxima reaches the threshold; a pivot whose block maxima do not reach it moves the cursors past that block; else lists
before it jump to it, and once all stand there it is scored. As all items above a fixed threshold are wanted, the threshold never rises. The sums of
block maxima, which no order of reading changes, are first taken for many passages at once: most passages have no block left and get no cursors.
A retrieved item is then
verified on five-word shingles of the whole document: at least 0.8 of the item's, and at least half of those of its
question and of its answer. Without a column for it, the last third of an item's words stands for its
answer; with one, question and answer are indexed apart and may stand apart in a document. A part of fewer than five words is
looked up as a run of its own length.

Scale: documents are read once, whole, without a shuffle. Document frequencies and the mean length are counted by Spark over the whole benchmark, so
scores do not depend on slices. The index is built by Spark tasks in slices of about SLICE items or SLICE_BYTES bytes (a single larger item is a slice of its own size), each
a bounded broadcast. All slices are read in one Python stage: it hashes about SWEEP bytes of texts once and takes the slices one after another, so that a worker
holds one slice, and its executor's disk all of them.

Edge cases: a null or empty text, and one without words, is clean. An item without words matches nothing; one with fewer than five words
is a single shingle, its whole sequence, anywhere in a document. Repeated items each count. Repeated rows are judged each;
a null doc_id is a row like others. Empty tables: an empty benchmark leaves all clean. Very long texts are read whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, shingle_hashes, small, swept, table, with_columns, written

PASSAGE = 128
RETRIEVE = 0.5
SIMILAR, PART_SIMILAR = 0.8, 0.5
ANSWER_PART = 1 / 3
K1, B = 1.2, 0.75
#: Items in a block, or more where that would make over BLOCKS blocks.
BLOCK, BLOCKS = 2, 128
SLICE, SLICE_BYTES = 20_000, 8 << 20
#: Bytes of text that meet all slices before the next texts are read, if there are several.
SWEEP = 8 << 20
_CHUNK = PASSAGE // 2


def _separators() -> np.ndarray:
    """Words here are runs of ASCII letters and digits and of all other characters; ASCII signs separate them."""
    b = np.zeros(256, bool)
    b[[i for i in range(128) if not chr(i).isalnum()]] = True
    return b


def _hasher() -> Words:
    w = Words()
    w.blank = _separators()
    return w


def _chunked(hasher: Words, text: str | None, answer: str | None) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """An item's words, where its answer begins, and what is indexed: runs of half a passage, apart for an answer of its own."""
    words, bounds = hasher.of_texts([(text or "").encode("utf-8", "replace"), (answer or "").encode("utf-8", "replace")])
    cut = int(bounds[1]) if answer else len(words) - int(len(words) * ANSWER_PART)
    parts = (words[:cut], words[cut:]) if answer else (words,)
    return words, cut, [part[at : at + _CHUNK] for part in parts for at in range(0, len(part), _CHUNK)]


def build_index(items: list[tuple[int, str, str | None]], df: tuple[np.ndarray, np.ndarray] | None = None, n: int | None = None, mean: float | None = None) -> dict:
    """items: (item_id, text or question, answer or None).

    df (sorted words, the number of chunks with each), n (chunks) and mean (words in a chunk) are those of the whole benchmark; by default of these items."""
    hasher = _hasher()
    ids, whole, asked, answered, runs, chunks, chunk_of = [], [], [], [], [], [], []
    for item, text, answer in items:
        words, cut, mine = _chunked(hasher, text, answer)
        if len(words):
            chunks += mine
            chunk_of += [len(ids)] * len(mine)
            ids.append(item)
            asked.append(shingle_hashes(words[:cut]))
            answered.append(shingle_hashes(words[cut:]))
            runs.append({min(5, k) for k in (len(words), cut, len(words) - cut) if k} | {5})
            whole.append(np.concatenate((asked[-1], answered[-1])) if answer else shingle_hashes(words))
    vocabulary = np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)
    each = [np.unique(np.searchsorted(vocabulary, c), return_counts=True) for c in chunks]
    sizes = np.array([len(c) for c in chunks], float)
    n, mean = n or len(chunks), mean or (sizes.mean() if chunks else 1.0)
    term = np.concatenate([t for t, _ in each]) if chunks else np.zeros(0, np.int64)
    tf = np.concatenate([f for _, f in each]) if chunks else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(chunks)), [len(t) for t, _ in each])
    known = np.bincount(term, minlength=len(vocabulary)) if df is None else df[1][np.searchsorted(df[0], vocabulary)]
    w = np.log1p((n - known + 0.5) / (known + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
    w = (w / np.bincount(doc, w, len(chunks))[doc]).astype(np.float32)
    order = np.lexsort((doc, term))
    term, doc, w = term[order], doc[order], w[order]
    block = max(BLOCK, -(-len(chunks) // BLOCKS))
    blocks = max(1, -(-len(chunks) // block))
    key, starts = np.unique(term * blocks + doc // block, return_index=True)
    bound = np.maximum.reduceat(w, starts) if len(w) else w
    posting_at = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    block_at = np.searchsorted(key, np.arange(len(vocabulary) + 1) * blocks)
    # Lists in at least a quarter of the blocks also have their maxima as rows of a matrix, at most four times the size of the list itself.
    long = np.flatnonzero(np.diff(block_at) * 4 >= blocks)
    row = np.zeros(len(vocabulary), np.int64)
    row[long] = np.arange(1, len(long) + 1)
    rows = np.zeros((len(long) + 1, blocks), np.float32)
    mine = row[key // blocks]
    rows[mine, key % blocks] = bound
    rows[0] = 0
    return {
        "ids": np.array(ids, np.int64), "whole": whole, "asked": asked, "answered": answered, "runs": runs, "chunk_of": np.array(chunk_of, np.int64), "n": len(chunks), "block": block, "blocks": blocks,
        "vocabulary": vocabulary, "posting_at": posting_at, "posting_doc": doc, "posting_weight": w, "posting_key": term * max(1, len(chunks)) + doc,
        "most": np.maximum.reduceat(w, posting_at[:-1]) if len(w) else w, "block_at": block_at, "block_key": key, "bound": bound, "row": row, "rows": rows,
    }


def _block_sums(index: dict, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of terms (starts: where runs begin), the sum of their maxima in every block."""
    out = np.add.reduceat(index["rows"][index["row"][t]], starts, axis=0)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    few = np.flatnonzero(index["row"][t] == 0)
    first = index["block_at"][t[few]]
    many = index["block_at"][t[few] + 1] - first
    where = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(run[few], many) * index["blocks"] + index["block_key"][where] % index["blocks"]
    return out + np.bincount(at, index["bound"][where], out.size).reshape(out.shape)


def wand(index: dict, terms: np.ndarray, live: np.ndarray, threshold: float) -> list[int]:
    """The chunks that the distinct terms score at least the threshold against. live: blocks that may hold one (others are jumped over)."""
    n, block, blocks = index["n"], index["block"], index["blocks"]
    docs, keys, end = index["posting_doc"], index["posting_key"], index["posting_at"][terms + 1]
    most, hits = index["most"][terms].astype(float), []
    following = np.append(np.where(live, np.arange(blocks), blocks), blocks)
    following = np.minimum.accumulate(following[::-1])[::-1]  # the first live block from each on

    def stand(lists, target):  # cursors of these lists at their first posting from target on
        at[lists] = np.searchsorted(keys, terms[lists] * n + target)
        inside = at[lists] < end[lists]
        doc[lists] = np.where(inside, docs[np.minimum(at[lists], len(docs) - 1)], n)

    at, doc = np.empty(len(terms), np.int64), np.empty(len(terms), np.int64)
    stand(np.arange(len(terms)), 0)
    while True:
        order = np.argsort(doc, kind="stable")
        p = int(np.searchsorted(np.cumsum(most[order]), threshold - 1e-6))
        if p == len(order) or (pivot := int(doc[order[p]])) == n:
            return hits
        reached = int(np.searchsorted(doc[order], pivot, side="right"))
        lists, b = order[:reached], pivot // block
        if not live[b]:
            stand(lists, min(n, int(following[b]) * block))
            continue
        key = terms[lists] * blocks + b
        where = np.minimum(np.searchsorted(index["block_key"], key), len(index["block_key"]) - 1)
        if index["bound"][where][index["block_key"][where] == key].sum(dtype=float) < threshold - 1e-6:
            stand(lists, min((b + 1) * block, int(doc[order[reached]]) if reached < len(order) else n))
        elif doc[order[0]] == pivot:
            if index["posting_weight"][at[lists]].sum(dtype=float) >= threshold - 1e-6:
                hits.append(pivot)
            stand(lists, pivot + 1)
        else:
            stand(lists[doc[lists] < pivot], pivot)


def candidates(index: dict, words: np.ndarray, bounds: np.ndarray, threshold: float = RETRIEVE) -> list[set[int]]:
    """Per document, the items that some passage of it retrieves."""
    found: list[set[int]] = [set() for _ in range(len(bounds) - 1)]
    vocabulary, half = index["vocabulary"], PASSAGE // 2
    if not len(vocabulary) or not len(words):
        return found
    term = np.searchsorted(vocabulary, words)
    term[term == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[term] == words)
    if not len(known):
        return found
    doc = np.searchsorted(bounds, known, side="right") - 1
    halves = -(-np.diff(bounds) // half)
    first = np.concatenate(([0], np.cumsum(halves)))
    key = np.unique((first[doc] + (known - bounds[doc]) // half) * len(vocabulary) + term[known])
    seg, t = key // len(vocabulary), key % len(vocabulary)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    seg_ids = seg[starts]
    ends = np.concatenate((starts[1:], [len(seg)]))
    sums = np.empty((len(starts), index["blocks"]), np.float32)
    for at in range(0, len(starts), 256):  # a few MB at a time
        lo, hi = starts[at], ends[min(at + 256, len(ends)) - 1]
        sums[at : at + 256] = _block_sums(index, t[lo:hi], starts[at : at + 256] - lo)
    follows = np.concatenate(((seg_ids[1:] == seg_ids[:-1] + 1) & ~np.isin(seg_ids[1:], first), [False]))
    both = sums.copy()
    both[follows] += sums[1:][follows[:-1]]
    live = both >= threshold - 1e-5
    for i in np.flatnonzero(live.any(1)):
        terms = np.unique(np.concatenate((t[starts[i] : ends[i]], t[starts[i + 1] : ends[i + 1]]))) if follows[i] else t[starts[i] : ends[i]]
        if hits := wand(index, terms, live[i], threshold):
            found[int(np.searchsorted(first, seg_ids[i], side="right")) - 1].update(index["chunk_of"][hits].tolist())
    return found


def _share(part: np.ndarray, of: np.ndarray) -> float:
    """The share of the distinct shingles of an item's part that a document (sorted shingles) has."""
    part = np.unique(part)
    at = np.minimum(np.searchsorted(of, part), len(of) - 1)
    return float((of[at] == part).mean()) if len(part) else 1.0


def leaks(index: dict, words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, float]]]:
    """Per document, (item_id, share) of the verified items; parts of fewer than five words are runs of their own length."""
    out = []
    for d, items in enumerate(candidates(index, words, bounds)):
        mine = []
        if items:
            lengths = set().union(*(index["runs"][i] for i in items))
            sh = np.unique(np.concatenate([shingle_hashes(words[bounds[d] : bounds[d + 1]], n) for n in sorted(lengths)]))
            for i in sorted(items):
                share = _share(index["whole"][i], sh)
                if share >= SIMILAR - 1e-9 and min(_share(index["asked"][i], sh), _share(index["answered"][i], sh)) >= PART_SIMILAR:
                    mine.append((int(index["ids"][i]), share))
        out.append(mine)
    return out


def _pass(docs: DataFrame, held: list, text_col: str) -> DataFrame:
    """docs with items and overlap: one Python stage, which hashes a text once and reads the held indexes one after another."""

    def make():
        hasher = _hasher()

        def compute(texts):
            words, bounds = hasher.of_texts(texts)
            items: list[set[int]] = [set() for _ in texts]
            overlap = np.zeros(len(texts))
            for index in swept(held):
                for d, found in enumerate(leaks(index, words, bounds)):
                    for item, share in found:
                        items[d].add(item)
                        overlap[d] = max(overlap[d], share)
            return [pa.array([sorted(i) for i in items], pa.list_(pa.int64())), pa.array(overlap)]

        return compute

    return with_columns(docs, text_col, "items array<long>, overlap double", make, unit=SWEEP if len(held) > 1 else None)


def _terms(items: DataFrame) -> DataFrame:
    """(slice, term, size) of each chunk: its distinct words, and its number of words beside one of them."""

    def make(batches):
        hasher = _hasher()
        for batch in batches:
            part, text, answer = (batch.column(c).to_pylist() for c in ("slice", "text", "answer"))
            for k, (x, y) in enumerate(zip(text, answer, strict=True)):
                for chunk in _chunked(hasher, x, y)[2]:
                    t = np.unique(chunk)
                    size = np.zeros(len(t), np.int64)
                    size[0] = len(chunk)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), part[k], np.int32)), pa.array(t.view(np.int64)), pa.array(size)], ["slice", "term", "size"])

    return items.mapInArrow(make, "slice int, term long, size long")


def indexes(items: DataFrame, slices: int) -> DataFrame:
    """(slice, index): the index of each slice of items (item_id, text, answer, slice), over the statistics of all; built by Spark tasks."""
    terms = written(_terms(items), "item-terms")
    total = terms.agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("words")).first()
    n, mean = int(total["n"]), float(total["words"] or 0) / max(1, total["n"])
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    of_slice = df.withColumn("slice", F.lit(0)) if slices == 1 else terms.select("slice", "term").distinct().join(small(df), "term")

    def build(items: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(i), *(x if isinstance(x, str) else None for x in (t, a))) for i, t, a in zip(items["item_id"], items["text"], items["answer"], strict=True)]
        term, many = df["term"].to_numpy(np.int64).view(np.uint64), df["df"].to_numpy(np.int64)
        order = np.argsort(term)
        index = build_index(sorted(rows, key=repr), (term[order], many[order]), n, mean)
        return pd.DataFrame({"slice": items["slice"].iloc[:1], "index": [pickle.dumps(index)]})

    out = items.groupBy("slice").cogroup(of_slice.groupBy("slice")).applyInPandas(lambda left, right: build(left, right) if len(left) else pd.DataFrame({"slice": [], "index": []}), "slice int, index binary")
    out = written(out, "item-index")
    discard(terms)
    return out


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """docs with items (ids of the leaked items, ascending), overlap (the largest share of an item's shingles), n_items and contaminated."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    items = items.where("item_id is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))).alias("bytes")).first()
    slices = max(1, -(-size["n"] // SLICE), -(-(size["bytes"] or 0) // SLICE_BYTES))
    built = indexes(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(slices)).cast("int")), slices)
    # One bounded slice of the index at a time passes through the driver into a broadcast of its own.
    held = [docs.sparkSession.sparkContext.broadcast(pickle.loads(row["index"])) for row in built.select("index").toLocalIterator()]
    out = _pass(docs.drop("items", "overlap", "n_items", "contaminated"), held, text_col)
    discard(built)
    return out.withColumn("n_items", F.size("items")).withColumn("contaminated", F.size("items") > 0)


def op6_decontaminate(spark, sf_dir) -> DataFrame:
    return matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "items", "n_items", "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
c AS (SELECT item_id, ws, len(ws) - CAST(floor(len(ws) / 3) AS BIGINT) AS cut FROM b WHERE len(ws) > 0),
p AS (SELECT item_id, 'w' AS part, ws FROM c UNION ALL SELECT item_id, 'q', ws[1:cut] FROM c UNION ALL SELECT item_id, 'a', ws[cut + 1:] FROM c),
ps AS (SELECT DISTINCT item_id, part, array_to_string(ws[i : i + 4], ' ') AS sh FROM p, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
pn AS (SELECT item_id, part, count(*) AS n FROM ps GROUP BY ALL),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM d, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
h AS (SELECT doc_id, item_id, part, count(*) AS hit FROM ps JOIN ds USING (sh) GROUP BY ALL),
k AS (SELECT item_id, count(*) AS parts FROM pn WHERE part <> 'w' GROUP BY item_id),
s AS (
  SELECT h.doc_id, h.item_id FROM h JOIN pn USING (item_id, part) JOIN k USING (item_id)
  GROUP BY h.doc_id, h.item_id, parts HAVING max(CASE WHEN part = 'w' THEN hit / n END) >= 0.8 AND count(*) FILTER (WHERE part <> 'w' AND hit / n >= 0.5) = parts)
SELECT d.doc_id, coalesce(list(s.item_id ORDER BY s.item_id) FILTER (WHERE s.item_id IS NOT NULL), []) AS items,
  CAST(count(s.item_id) AS INTEGER) AS n_items, count(s.item_id) > 0 AS contaminated
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
