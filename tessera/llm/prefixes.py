"""Conversation prefix trie: how much conversations share from their first turn on, from balanced parentheses kept by shards.

A conversation is a sequence of turns (role, text), and each distinct sequence of first turns is a node of a trie. Sequences are cut into segments of
SEGMENT turns; a segment's row holds the digests of its turns and the name of the node it starts from, so no row or group grows with a conversation.
Equal segments are one row with a count. Rows are dealt to shards by range of (start, digests), which is the order in which a trie is walked, so a
subtree is a run of rows. A shard writes its part of the trie as balanced parentheses: findclose, on a tree of minima over blocks of the excess, gives the end of each node's subtree;
ranks of leaf pairs `()` count leaves; cumulative arrays over the nodes in order give members and savings. Nodes on the path between two
neighbouring shards, the shared spines, are met by both; each knows the other's last or first row, counts only what begins with itself, and the parts of a node are added up.

Segments that start deeper are walked first where several conversations share their start (one round for each SEGMENT turns of the longest
prefix that is shared by different conversations); what they hold is grafted on the leaves they start from. Those of a single conversation
have known values and are walked with the first segments.

Scale: texts are read once and leave the first step as 16-byte digests and lengths. Conversations are ordered in ranges of rows, so a conversation
with most of the rows is ordered by many tasks, and numbers within it are sums over ranges. A group of copies is one row. Only the list of
conversations that end at a node, whose digest is sequential by nature, is read by one task, in order and without being held.

Edge cases: turns are ordered with null first, then by role and digest of the text where turns are equal; a null role or text is empty. Repeated rows are turns
each. A row without conv_id belongs to no conversation and is left out. A conversation without turns is a member of the root. Very long texts are only
hashed and counted; other columns, whatever their names, are left out. An empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small, small_batches, table, written

#: Turns of a segment, bytes of a turn's digest, nodes of a shard, and rows of a range of turns that one task orders (all but the second about).
SEGMENT, DIGEST, SHARD_NODES, RANGE_ROWS = 256, 16, 1 << 15, 1 << 20
ROOT = "0"


# --- turns -----------------------------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (1, 2, ... within the conversation), token (digest of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), token.alias("token"), F.length(text).cast("long").alias("chars")
    )
    rows = written(rows, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("token")]
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // RANGE_ROWS)), F.col("conv_id"), *order)
    parts = written(ranges.withColumn("part", F.spark_partition_id()), "turn-ranges")
    counts = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    out = parts.withColumn("nth", nth).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    out = written(out.select("conv_id", (F.col("before") + F.col("nth")).alias("i"), "token", "chars"), "ordered-turns")
    for t in (rows, parts):
        discard(t)
    return out


def rebuilt_turns(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first h turns of conversation c - c % every, then come its own after its first h;
    h = crc32(c) % heads. turns: conv_id, i, token, chars, total; conversations: conv_id, total (its turns)."""
    n = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    own = n.select("conv_id", "n", h.alias("h"), F.expr(f"conv_id - conv_id % {every}").alias("giver"))
    of_giver = n.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("giver"), F.col("n").alias("given"))
    convs = own.join(of_giver, "giver", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = written(convs.select("conv_id", "giver", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    rest = turns.join(convs.drop("giver"), "conv_id").where("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("i"), "token", "chars", "total")
    first = turns.where((F.col("i") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "giver")  # at most heads - 1 rows a giver
    first = first.join(convs.select("conv_id", "giver", "h", "total"), "giver").where("i <= h").select("conv_id", "i", "token", "chars", "total")
    return rest.unionByName(first), convs.select("conv_id", "total")


# --- segments --------------------------------------------------------------------------------------------------------


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Per conversation and segment: conv_id, seg, path (digests), chars, last; root and next: names of the nodes where it starts and, if it is full, ends; key: of the node where it ends."""
    held = F.sort_array(F.collect_list(F.struct("i", "token", "chars")))
    rows = turns.groupBy("conv_id", F.expr(f"(i - 1) div {SEGMENT}").alias("seg"), "total").agg(held.alias("held"))
    path = F.unhex(F.array_join(F.transform("held", lambda x: F.hex(x["token"])), ""))
    rows = rows.select("conv_id", "seg", "total", path.alias("path"), F.col("held.chars").alias("chars"))
    none = convs.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), "total", F.unhex(F.lit("")).alias("path"), F.array().cast("array<long>").alias("chars"))
    rows = written(rows.unionByName(none).withColumn("last", F.col("seg") == F.expr(f"greatest(0, (total - 1) div {SEGMENT})")), "segments")
    # A start is named by sums of digests of the segments before it with their numbers; only conversations with a full segment have one.
    long = rows.where(f"total >= {SEGMENT}").select("conv_id", "seg", F.sha2(F.concat(F.encode(F.concat("seg", F.lit(":")), "utf-8"), "path"), 256).alias("d"))
    upto = Window.partitionBy("conv_id").orderBy("seg")  # narrow rows, one for SEGMENT turns
    parts = [F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    name = lambda seg, frame: F.concat_ws(":", seg, *[F.sum(p).over(frame) for p in parts])
    named = long.select(
        "conv_id", "seg",
        F.when(F.col("seg") > 0, name(F.col("seg"), upto.rowsBetween(Window.unboundedPreceding, -1))).alias("root"),
        name(F.col("seg") + 1, upto.rowsBetween(Window.unboundedPreceding, 0)).alias("next"),
    )
    out = rows.join(small(named), ["conv_id", "seg"], "left").withColumn("root", F.coalesce("root", F.lit(ROOT)))
    out = out.withColumn("next", F.when(F.length("path") == SEGMENT * DIGEST, F.col("next")))
    key = F.when(F.length("path") == 0, F.col("root")).otherwise(F.coalesce("next", F.md5(F.concat(F.encode("root", "utf-8"), F.col("path")))))
    return written(out.withColumn("key", key).select("conv_id", "seg", "path", "chars", "last", "root", "next", "key"), "named-segments")


def _end_digests(batches):
    """key, ends_sha256: rows come by key and, within it, by conv_id; a list is hashed as it passes."""
    key, running = None, None
    for batch in batches:
        done = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                running.update(b",%d" % c)
            else:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(b"%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: of the conv_ids of each key, in numeric order and joined by commas."""
    rows = ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return small_batches(rows).mapInArrow(_end_digests, "key string, ends_sha256 string")


# --- balanced parentheses --------------------------------------------------------------------------------------------


class Parentheses:
    """A sequence of 1 (open) and 0 (close) with a tree of minima over blocks of its excess."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        padded = np.full(-(-max(1, len(bits)) // self.BLOCK) * self.BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = excess
        self.excess = padded.reshape(-1, self.BLOCK)
        self.minima = [self.excess.min(1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            low = np.concatenate((low, [np.iinfo(np.int32).max])) if len(low) % 2 else low
            self.minima.append(low.reshape(-1, 2).min(1))

    def _in_block(self, block: np.ndarray, after: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place of a block, after `after`, whose excess is at most `want`; -1 if there is none."""
        out = np.full(len(block), -1, np.int64)
        for lo in range(0, len(block), 1 << 14):
            b = block[lo : lo + (1 << 14)]
            hit = (self.excess[b] <= want[lo : lo + len(b), None]) & (np.arange(self.BLOCK) > after[lo : lo + len(b), None])
            some = hit.any(1)
            out[lo : lo + len(b)][some] = b[some] * self.BLOCK + hit[some].argmax(1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        want = self.excess.reshape(-1)[opens] - 1
        block = opens // self.BLOCK
        out = self._in_block(block, opens % self.BLOCK, want)
        rest = np.flatnonzero(out < 0)
        at, level, want = block[rest], np.full(len(rest), -1), want[rest]
        for k, low in enumerate(self.minima):  # up, until a sibling to the right reaches down far enough
            up = level < 0
            right = np.minimum(at + 1, len(low) - 1)
            hit = up & (at % 2 == 0) & (at + 1 < len(low)) & (low[right] <= want)
            at, level = np.where(hit, at + 1, np.where(up, at // 2, at)), np.where(hit, k, level)
        for k in range(len(self.minima) - 1, 0, -1):  # and down to the first such block
            down = level == k
            left = np.minimum(2 * at, len(self.minima[k - 1]) - 1)
            at = np.where(down, np.where(self.minima[k - 1][left] <= want, 2 * at, 2 * at + 1), at)
            level = np.where(down, k - 1, level)
        out[rest] = self._in_block(at, np.full(len(at), -1), want)
        return out


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their start."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_NODE = "key string, parent string, depth long, low long, parent_low long, n_convs long, n_children long, n_leaves long, saved long, spine boolean, graft_leaves long, graft_saved long"


def _shard_nodes(segment: int):
    """From a shard's rows, its part of each node's values."""

    def walk(t: pa.Table) -> pa.Table:
        col = {c: t[c].to_pylist() for c in ("root", "seg", "path", "chars", "w", "low", "next", "graft_leaves", "graft_saved")}
        order = sorted(range(t.num_rows), key=lambda i: (col["root"][i], col["path"][i]))
        prev_root, prev_path, next_root, next_path = (t[c][0].as_py() for c in ("prev_root", "prev_path", "next_root", "next_path"))
        first, last = order[0], order[-1]
        left = _shared(prev_path, col["path"][first]) if prev_root == col["root"][first] else -1
        right = _shared(next_path, col["path"][last]) if next_root == col["root"][last] else -1
        bits, parent, depth, chars, keys = bytearray(), [], [], [], []
        weight, low, leaves, saved, new, spine, start = [], [], [], [], [], [], []
        stack, hashes, root, path = [], [], None, b""

        def opened(up: int, d: int, n: int, key: str, is_new: bool, on_spine: bool) -> None:
            stack.append(len(parent))
            bits.append(1)
            for values, x in ((parent, up), (depth, d), (chars, n), (keys, key), (weight, 0), (low, None), (leaves, 0), (saved, 0), (new, is_new), (spine, on_spine), (start, False)):
                values.append(x)

        def closed(keep: int) -> None:
            while len(stack) > keep:
                bits.append(0)
                stack.pop()
                hashes.pop()

        for i in order:
            here = -1 if i != first else left  # nodes down to this depth began in a shard before
            beyond = -1 if i != last else right  # and down to this one go on in a shard after
            if col["root"][i] != root:
                closed(0)
                root, path = col["root"][i], b""
                opened(-1, col["seg"][i] * segment, 0, root, here < 0, False)
                start[-1] = col["seg"][i] > 0
                hashes.append(hashlib.md5(root.encode()))
            mine = col["path"][i]
            common, n = _shared(path, mine), len(mine) // DIGEST
            closed(common + 1)
            for d in range(common, n):
                h = hashes[-1].copy()
                h.update(mine[d * DIGEST : (d + 1) * DIGEST])
                hashes.append(h)
                full = d + 1 == segment
                opened(stack[-1], depth[stack[0]] + d + 1, col["chars"][i][d], col["next"][i] if full else h.hexdigest(), d + 1 > here, full)
            for d in range(max(here, beyond) + 1):
                spine[stack[d]] = True
            node = stack[-1]
            weight[node], low[node] = col["w"][i], col["low"][i]
            if col["graft_leaves"][i] is not None:
                leaves[node], saved[node] = col["graft_leaves"][i] - 1, col["graft_saved"][i]
            elif beyond == n:  # its first children are in the next shard
                leaves[node] = -1
            path = mine
        closed(0)

        size = len(parent)
        marks = np.frombuffer(bytes(bits), np.uint8)
        opens = np.flatnonzero(marks)
        closes = Parentheses(marks).findclose(opens)
        first_node, end = np.arange(size), np.arange(size) + (closes - opens + 1) // 2
        pair = np.concatenate(([0], np.cumsum((marks[:-1] == 1) & (marks[1:] == 0))))  # rank of leaf pairs that begin before a place
        upto = lambda values: np.concatenate(([0], np.cumsum(np.array(values, np.int64))))
        over = lambda sums: sums[end] - sums[first_node]
        n_convs = over(upto(weight))
        n_leaves = pair[closes] - pair[opens] + over(upto(leaves))
        length, begins, above = np.array(chars, np.int64), np.array(new), np.array(parent)
        total = over(upto((n_convs - begins) * length + np.array(saved, np.int64)))
        children = np.bincount(above[begins & (above >= 0)], minlength=size)
        for v in range(size - 1, 0, -1):
            up = parent[v]
            if up >= 0 and (low[up] is None or low[v] < low[up]):
                low[up] = low[v]
        grafted = np.array(start)  # a deeper start is a node of the segment above: only its children are counted here
        on_spine = np.array(spine) | grafted
        ints = lambda a, none=None: pa.array(np.asarray(a, np.int64), mask=none)
        return pa.table(
            {
                "key": pa.array(keys), "parent": pa.array([keys[u] if u >= 0 else None for u in parent], pa.string()), "depth": ints(depth), "low": ints(low, grafted),
                "parent_low": pa.array([low[u] if u >= 0 and not on_spine[u] else None for u in parent], pa.int64()), "n_convs": ints(np.where(grafted, 0, n_convs)), "n_children": ints(children),
                "n_leaves": ints(np.where(grafted, 0, n_leaves)), "saved": ints(np.where(grafted, 0, total)), "spine": pa.array(on_spine),
                "graft_leaves": ints(n_leaves, ~grafted), "graft_saved": ints(total, ~grafted),
            }
        )

    return walk


def _walked(paths: DataFrame, grafts: DataFrame | None) -> DataFrame:
    """The nodes of one round, a row for each shard that holds a part of one."""
    if grafts is None:
        paths = paths.withColumns({"graft_leaves": F.lit(None).cast("long"), "graft_saved": F.lit(None).cast("long")})
    else:
        paths = paths.join(small(grafts.withColumnRenamed("key", "next")), "next", "left")
    nodes = paths.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = written(paths.repartitionByRange(max(1, -(-nodes // SHARD_NODES)), "root", "path").withColumn("shard", F.spark_partition_id()), "shards")
    edges = shards.groupBy("shard").agg(F.min(F.struct("root", "path")).alias("first"), F.max(F.struct("root", "path")).alias("last"))
    along = Window.orderBy("shard")  # a row for each shard
    edges = edges.select("shard", F.lag("last").over(along).alias("p"), F.lead("first").over(along).alias("n"))
    edges = edges.select("shard", F.col("p.root").alias("prev_root"), F.col("p.path").alias("prev_path"), F.col("n.root").alias("next_root"), F.col("n.path").alias("next_path"))
    found = written(shards.join(small(edges), "shard").groupBy("shard").applyInArrow(_shard_nodes(SEGMENT), _NODE), "nodes")
    discard(shards)
    return found


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, i (1, 2, ...), token (16 bytes), chars, total; convs: conv_id, total, conversations without turns included."""
    segs = segments(turns, convs)
    paths = segs.groupBy("root", "seg", "path").agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("low"), F.first("chars").alias("chars"), F.first("next").alias("next"))
    paths = written(paths, "paths")
    shared = written(paths.where("seg > 0").groupBy("root", "seg").agg(F.sum("w").alias("members")).where("members > 1").select("root", "seg"), "shared-starts")
    deepest = shared.agg(F.max("seg")).first()[0] or 0
    rounds, grafts = [], None
    for seg in range(deepest, 0, -1):
        found = _walked(paths.where(F.col("seg") == seg).join(small(shared.select("root")), "root", "left_semi"), grafts)
        grafts = found.where("graft_leaves is not null").groupBy("key").agg(F.sum("graft_leaves").alias("graft_leaves"), F.sum("graft_saved").alias("graft_saved"))
        rounds.append(found)
    rest = paths if not deepest else paths.join(small(shared.select("root")), "root", "left_anti")
    nodes = _walked(rest, grafts)
    for found in rounds:
        nodes = nodes.unionByName(found)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    spines = nodes.where("spine").groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("low").alias("low"), F.min("parent_low").alias("parent_low"), *sums)
    spines = written(spines, "spines")
    names = ["key", "parent", "depth", "low", "parent_low", "n_convs", "n_children", "n_leaves", "saved"]
    whole = nodes.where("not spine").select(names).unionByName(spines.select(names))
    whole = whole.join(small(spines.select(F.col("key").alias("parent"), F.col("low").alias("spine_low"))), "parent", "left")
    whole = whole.join(end_digests(segs.where("last")), "key", "left")
    return whole.select(
        F.col("low").alias("conv_id"), "depth", F.coalesce("spine_low", "parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie(*rebuilt_turns(ordered_turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(i) AS n FROM o GROUP BY conv_id),
bit8 AS (SELECT x.range AS x, list_reduce([CAST(x.range AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS y FROM range(256) x),
crc_table AS (SELECT list(y ORDER BY x) AS t FROM bit8),
c AS (SELECT conv_id, n, conv_id - conv_id % 100 AS giver,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(conv_id AS VARCHAR)[k]) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM n, crc_table),
b AS (SELECT c.conv_id, c.giver, h, least(h, coalesce(g.n, 0)) AS taken FROM c LEFT JOIN n g ON g.conv_id = c.giver),
r AS (SELECT b.conv_id, taken + i - h AS d, role, text FROM o JOIN b USING (conv_id) WHERE i > h
  UNION ALL SELECT b.conv_id, i, role, text FROM b JOIN o ON o.conv_id = b.giver WHERE i <= h),
k AS (SELECT conv_id, d, len(text) AS chars, string_agg(len(role) || ':' || len(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM n),
s AS (SELECT conv_id, max(d) AS total FROM k GROUP BY conv_id),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM k GROUP BY key),
up AS (SELECT x.key, y.key AS parent FROM nodes x JOIN k y ON y.conv_id = x.conv_id AND y.d = x.depth - 1),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
above AS (SELECT y.key, x.key AS below, x.n_convs, x.chars FROM nodes x JOIN k y ON y.conv_id = x.conv_id AND y.d <= x.depth),
sums AS (SELECT a.key, sum((a.n_convs - 1) * a.chars) AS saved, count(*) FILTER (kids.key IS NULL) AS n_leaves FROM above a LEFT JOIN kids ON kids.key = a.below GROUP BY a.key),
ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM k JOIN s USING (conv_id) WHERE d = total GROUP BY key)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN up ON up.key = nodes.key LEFT JOIN nodes p ON p.key = up.parent
"""
