"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds 64-bit hashes of its distinct five-word shingles. Documents with equal sets are one node, so that
exact copies cost one row each. One pass hashes a set into BINS bins; an empty bin takes the minimum of the first
non-empty bin that a shared sequence of random bins meets. BANDS bands of ROWS minima name BANDS buckets for each node:
at similarity 0.85 two nodes share no bucket with probability (1 - 0.85**5)**32, about 7e-9.

Links come from two steps. First each bucket is a star around the member that has the most company over all its buckets (in a group of
edited copies this is the common origin); the stars' edges are confirmed and joined into components. The second step is exact for what
is left: in every bucket that still holds several components, each member outside the bucket's largest one meets all members of other
components, in blocks of BLOCK rows, on minima of one byte each. Pairs that are not more than five standard deviations under the
threshold connect nodes to families; within a family all pairs of different components are compared on full sets, in blocks of
at most BLOCK rows and SET_BLOCK shingles, as products of incidence matrices of what distinguishes the sets. Blocks of a single component, and blocks whose sizes are too far
apart for the threshold, never meet. No window, split or cap decides which pairs are compared.

Scale: texts are read twice, the second time only for members of buckets, whose sets are kept; what is shuffled else are bucket keys (8 bytes a
band) and minima. A bucket in one component costs nothing in the second step, however large; otherwise the work is (members outside its largest component) x (members),
spread over tasks by pairs of blocks. Tasks return spanning edges (fewer than their rows), never pairs. Components come from the
large-star/small-star iteration on tables in the shared folder; nothing is collected.

Edge cases: a document without words has no set, links with nothing and stays; one with fewer than five words has its
whole sequence as one shingle. A null doc_id links with nothing and stays, with a null component. Repeated rows of one
doc_id are copies; rows of one doc_id with different texts are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BLOCK, Words, discard, in_blocks, mixed, shingle_hashes, small, small_batches, table, written

BANDS, ROWS = 32, 5
#: Rows, and shingles of a family's sets, that one side of a block comparison holds at most (one set may be larger).
BLOCK, SET_BLOCK = 4096, 1 << 20
#: Rows of one side whose pairs are looked at together.
STRIP = 256
#: Columns of an incidence matrix at a time.
SLAB = 2048
_TRIES = 4096
_U = np.uint64


def _sets(texts: list[bytes], words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = words.of_texts(texts)
    out = []
    for i in range(len(texts)):
        s = np.sort(shingle_hashes(hashes[bounds[i] : bounds[i + 1]]))
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def densified(minima: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Each empty bin copies the bin that its own random sequence of bins meets first among the filled ones."""
    bins = minima.shape[1]
    out = minima.copy()
    row, col = np.nonzero(~filled)
    for t in range(_TRIES):
        if not len(row):
            return out
        j = (mixed((col + bins * t + 1).astype(_U)) % _U(bins)).astype(np.int64)
        hit = filled[row, j]
        out[row[hit], col[hit]] = minima[row[hit], j[hit]]
        row, col = row[~hit], col[~hit]
    out[row, col] = minima[row, filled.argmax(1)[row]]
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    minima, filled = np.zeros((len(sets), bins), _U), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        b = ((s >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        minima[i, b[first]] = s[first]
        filled[i, b[first]] = True
    return densified(minima, filled)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), _U)
    for b in range(bands):
        h = np.full(len(sig), b + 1, _U)
        for r in range(rows):
            h = mixed(h * _U(31) + sig[:, b * rows + r])
        keys[:, b] = h
    return keys


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def _feature_maker(bands: int, rows: int):
    def make(batches):
        words = Words()
        for batch in batches:
            texts = _texts(batch)
            for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
                sets = _sets(texts[lo:hi], words)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                full = [sets[i] for i in some]
                sums = np.zeros((2, len(sets)), _U)
                for i, s in zip(some, full, strict=True):
                    sums[0, i], sums[1, i] = mixed(s).sum(), mixed(s ^ _U(0x5851F42D4C957F2D)).sum()
                sig = signatures(full, bands * rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
                short = np.zeros((len(sets), bands * rows), np.uint8)
                short[some] = (mixed(sig) >> _U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(sig, bands, rows).reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "keys", "sig"],
                )

    return make


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, (k1, k2) which name the set, the bucket keys, and the minima as one byte each."""
    return small_batches(docs).mapInArrow(_feature_maker(bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, sig binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set, for documents that need a full comparison."""

    def make(batches):
        words = Words()
        for batch in batches:
            texts = _texts(batch)
            for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
                sets = _sets(texts[lo:hi], words)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "shingles"])

    return small_batches(docs).mapInArrow(make, "doc_id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Large-star and small-star steps until nothing changes."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "edges")
        discard(now)
        now, last = new, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _agreeing(bins: int, percent: int, sizes) -> np.ndarray:
    """How many of the one-byte minima of two sets at the threshold agree, less five standard deviations. sizes: of the smaller set, whose few shingles fill many bins alike."""
    j = percent / 100
    return bins * (j - 5 * np.sqrt(j * (1 - j) * (1 / bins + 2 / np.maximum(1, sizes))))


def _near_by_bytes(bins: int, percent: int):
    """Keeps pairs (a, b, size and sig of a, of b) whose one-byte minima agree often enough."""

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                least = _agreeing(bins, percent, np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
                yield batch.filter(pa.array((a == b).sum(1) >= least)).select(["a", "b"])

    return keep


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. sets: (node, shingles)."""
    near = written(pairs.distinct(), "near-pairs")
    of = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    links = near.join(of("b", "sb"), "b").join(of("a", "sa"), "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = written(links.where(F.lit(100) * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"), "links")
    discard(near)
    return links


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n): the buckets with at least two different members; n: their rows."""
    rows = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n")
    return written(rows.join(sizes, "key"), "buckets")


def _star(buckets: DataFrame, members: DataFrame, bins: int, percent: int) -> DataFrame:
    """Edges from each bucket's centre, the member with the most company, to the others, where the one-byte minima agree."""
    company = buckets.groupBy("node").agg(F.sum("n").alias("company"))
    rows = buckets.select("key", "node").join(company, "node")
    centre = rows.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    pairs = rows.select("key", "node").join(centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    sig = lambda c: members.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(sig("b"), "b").join(sig("a"), "a")
    return both.mapInArrow(_near_by_bytes(bins, percent), "a long, b long")


# --- the exact step: blocks ------------------------------------------------------------------------------------------


def _spanning(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what the pairs of places (i, j) connect: each place that has a pair, to the smallest name it is connected with."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    label = rank.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[order[new]])
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != rank)
    return names[order[label[moved]]], names[moved]


def _in_blocks(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """rows (narrow: the window sorts a group) with `block`: consecutive rows of a group, components together and by size: at most BLOCK rows, with sizes of about `most` in all."""
    upto = Window.partitionBy(group).orderBy("component", "n_shingles", "node").rowsBetween(Window.unboundedPreceding, -1)
    # A row costs its share of either bound, so a block of total cost 1 keeps both; costs are whole numbers, so that they add up exactly.
    unit = BLOCK * most
    cost = F.greatest(F.lit(unit // BLOCK), F.col(size).cast("long") * F.lit(unit // most))
    return rows.withColumn("block", F.floor(F.coalesce(F.sum(cost).over(upto), F.lit(0)) / unit).cast("int"))


def _met(rows: DataFrame, group: str, percent: int, payload: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (i, j), i <= j, of its group that has to be compared: (group, i, j, block, node, component, and payload's columns, met by node).

    Two blocks need no comparison if both hold one and the same component, or if the larger sets of one are too small for the other."""
    blocks = rows.groupBy(group, "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n_shingles").alias("n0"), F.max("n_shingles").alias("n1"))
    side = lambda x: blocks.select(group, *[F.col(c).alias(f"{c}_{x}") for c in ("block", "c0", "c1", "n0", "n1")])
    pairs = side("i").join(side("j"), group).where("block_i <= block_j and not (c0_i = c1_i and c0_j = c1_j and c0_i = c0_j)")
    pairs = pairs.where(F.expr(f"100 * n1_i >= {percent} * n0_j and 100 * n1_j >= {percent} * n0_i")).select(group, F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    each = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return rows.select(group, "block", "node", "component").join(each, [group, "block"]).join(payload, "node")


def _block_of(t: pa.Table) -> np.ndarray:
    """Which of its two blocks a row is of; without the column all are of one."""
    return t["block"].to_numpy() if "block" in t.column_names else np.zeros(t.num_rows, np.int32)


def _strips(names: np.ndarray, comp: np.ndarray, block: np.ndarray, near) -> pa.Table:
    """Spanning edges of the pairs of different components that near(rows, others) marks: of the block's own pairs, or of two blocks' pairs. STRIP rows at a time."""
    first = np.flatnonzero(block == block.min())
    other = np.flatnonzero(block == block.max())
    low, high = [np.zeros(0, names.dtype)], [np.zeros(0, names.dtype)]
    for lo in range(0, len(first), STRIP):
        rows = first[lo : lo + STRIP]
        others = other[lo:] if len(first) == len(block) else other  # one block: each pair once
        hit = near(rows, others) & (comp[rows][:, None] != comp[others][None])
        i, j = np.nonzero(hit)
        if len(i):
            a, b = _spanning(names, rows[i], others[j])
            low.append(a)
            high.append(b)
    return pa.table({"a": np.concatenate(low), "b": np.concatenate(high)})


def _by_bytes(bins: int, percent: int):
    """From the rows of one pair of blocks of a bucket: spanning edges of the pairs of different components whose minima agree."""

    def compare(t: pa.Table) -> pa.Table:
        node, comp, size = (t[c].to_numpy() for c in ("node", "component", "n_shingles"))
        block = _block_of(t)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(node), -1)

        def near(rows, others):
            theirs, same = sig[others], np.empty((len(rows), len(others)), bool)
            for k, r in enumerate(rows.tolist()):
                same[k] = (theirs == sig[r]).sum(1) >= _agreeing(bins, percent, np.minimum(size[others], size[r]))
            return same

        return _strips(node, comp, block, near)

    return compare


def _by_sets(percent: int):
    """From the rows of one pair of blocks of a family: spanning edges of the links between different components, on full sets.

    What most of the sets hold is left out: two sets differ in as many elements as their differences from that common part do. Intersections of the
    differences are products of 0/1 matrices, a slab of columns at a time; what a single set holds adds nothing. The largest array is a block by a block in single precision."""

    def compare(t: pa.Table) -> pa.Table:
        node, comp = (t[c].to_numpy() for c in ("node", "component"))
        block = _block_of(t)
        lists = t["shingles"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        values, at, held = np.unique(flat, return_inverse=True, return_counts=True)
        n, row = len(node), np.repeat(np.arange(len(node)), sizes)
        common = held * 2 > n
        full = int(common.sum())
        kept = np.bincount(row[common[at]], minlength=n)
        differ = (sizes - kept + full - kept).astype(np.int32)  # elements that a set has beside the common part or lacks of it
        first, other = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        place_of = np.full(n, -1)
        place_of[first] = np.arange(len(first))
        place_to = np.full(n, -1)
        place_to[other] = np.arange(len(other))
        shared = np.zeros((len(first), len(other)), np.float32)
        columns = np.flatnonzero((held > 1) & (held < n))
        for lo in range(0, len(columns), SLAB):
            part = columns[lo : lo + SLAB]
            place = np.full(len(values), -1, np.int32)
            place[part] = np.arange(len(part))
            mine = place[at] >= 0
            m = np.zeros((n, len(part)), np.float32)
            m[row[mine], place[at[mine]]] = 1
            flip = common[part]
            m[:, flip] = 1 - m[:, flip]
            left, right = (m, m) if len(first) == n else (m[first], m[other])
            for k in range(0, len(first), STRIP):
                shared[k : k + STRIP] += left[k : k + STRIP] @ right.T
        total_of = sizes.astype(np.int64)

        def near(rows, others):
            apart = differ[rows][:, None] + differ[others][None] - 2 * np.rint(shared[np.ix_(place_of[rows], place_to[others])]).astype(np.int32)
            total = total_of[rows][:, None] + total_of[others][None]
            return 100 * (total - apart) >= percent * (total + apart)

        return _strips(node, comp, block, near)

    return compare


def _rest(buckets: DataFrame, members: DataFrame, sets: DataFrame, comp: DataFrame, bins: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of all links between different components whose nodes share a bucket."""
    of_node = members.select("node", "n_shingles", "sig").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = buckets.select("key", "node").join(of_node.select("node", "component"), "node")
    several = named.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
    rows = named.drop("component").join(several, "key", "left_semi").join(of_node.drop("sig"), "node").withColumn("one", F.lit(1))
    placed = written(_in_blocks(rows, "key", "one", BLOCK).drop("one"), "bucket-blocks")
    close = _met(placed, "key", percent, members.select("node", "n_shingles", "sig")).groupBy("key", "i", "j").applyInArrow(_by_bytes(bins, percent), "a long, b long")
    families = components(close)
    both = families.union(families.select(F.col("component").alias("node"), "component")).distinct().withColumnRenamed("component", "family")
    own = both.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(members.select("node", "n_shingles"), "node")
    own = written(_in_blocks(own, "family", "n_shingles", SET_BLOCK), "family-blocks")
    links = written(_met(own, "family", percent, sets).groupBy("family", "i", "j").applyInArrow(_by_sets(percent), "a long, b long"), "links")
    for t in (placed, own):
        discard(t)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = written(features(docs, bands, rows), "features")
    usable = feats.where("n_shingles > 0 and doc_id is not null")
    names = written(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "sets")
    copies = written(usable.select("doc_id", "k1", "k2").join(names, ["k1", "k2"]).where("doc_id <> node").select("doc_id", "k1").distinct(), "copies")
    nodes = usable.join(small(copies), ["doc_id", "k1"], "left_anti").select("doc_id", "n_shingles", "keys", "sig")
    buckets = _buckets(nodes)
    ids = written(buckets.select(F.col("node").alias("doc_id")).distinct(), "members")
    members = written(nodes.join(small(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sig").dropDuplicates(["node"]), "members")
    sets = written(shingle_sets(docs.join(small(ids), "doc_id", "left_semi")).select(F.col("doc_id").alias("node"), "shingles"), "shingles")
    comp = components(confirmed(_star(buckets, members, bands * rows, percent), sets, percent))
    more = _rest(buckets, members, sets, comp, bands * rows, percent)
    comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    for t in (copies, buckets, ids, members, sets, more):
        discard(t)
    of_set = names.join(comp, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    out = feats.select("doc_id", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n ON n.doc_id = w.doc_id
"""
