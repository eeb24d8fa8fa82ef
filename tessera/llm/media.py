"""Media columns: local image descriptors find cropped or edited copies.

Each image gets its strongest corners over several scales; at each corner, an orientation (towards the intensity centroid) and BITS
binary brightness tests, turned by exactly that angle and read between pixels, so that changes of brightness or contrast, crops and turns
leave most bits as they are. Images of equal pixels are one class, and classes stand for their members.

Near classes come first: classes that share keys of three runs of 32 bits form stars around the member with the most company, and a class
joins a star's centre if one transform gets NEAR_VOTES votes. Then the descriptors of all query classes meet those of the centres in
twelve hash tables (joins on two of the eight runs); an image pair with a common key is compared on all its corners: pairs of corners within
HAMMING bits vote for the similarity transform that maps one image to the other, and a copy is one whose transform gets VOTES query corners.

The result names representatives: a query's matches are the centre of its own near class, which was compared with it, and the other
centres that it matches; near_id gives every image's centre, so that all copies of a query are the images whose near_id is its own or is among its matches.
Queries are centres only where all members are queries. Two corners meet in a table if two runs of their bits are equal: nearly all copies by crops, brightness, noise and turns
meet so, of those reduced by a fifth more than half (tests measure it against brute force); two unrelated images of the query do in about 2 of 10,000 cases.

Scale: images are read once; a row for each image with its corners as arrays is kept. What the tables shuffle are keys (8 bytes) and class
names; corner arrays go only to pairs that are compared, at most two a pass for each class and the hits of the queries. A group of nearly equal images adds one
comparison for each member, not one for each pair. Lists of names and the queries' keys are broadcast if counted to be small, else joined by shuffle.

The given tables hold no images, so the query renders one from each embedding (a sum of plane waves with the vector as amplitudes: close
vectors make nearly equal images) and, for every tenth, a cropped, brightened and in part turned copy. Image ids are twice the vec_id, plus 1 for an edited copy.

Edge cases: a null image, one without pixels, and one too small or too flat for corners matches nothing; null images are
in no class. Corners of equal strength are taken in the order of rows and columns. Repeated rows of an id are members of a class each. Empty tables give empty results; columns other than
media_id, width, height and pixels are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, small_batches, table, written

SIDE = 96
#: Scales, and the corners that an image of SIDE x SIDE pixels gets from each at most; a larger one gets more by its area.
SCALES = {1.0: 10, 1.25: 8, 1.5: 6, 2.0: 6}
BITS = 256
#: The pairs of runs of 32 bits that the search tables join on, and the triples for near classes.
TABLES = (*((t, (t + 1) % 8) for t in range(8)), *((t, t + 4) for t in range(4)))
NEAR_TABLES = tuple((t, (t + 2) % 8, (t + 5) % 8) for t in range(0, 8, 2))
HAMMING = 40
VOTES, NEAR_VOTES = 5, 8
#: Keys that a class shares with a near class's centre at least; passes of the search for near classes, and doublings of the way up in each.
SHARED, PASSES, JUMPS = 2, 2, 3
QUERY_EVERY = 20
_MARGIN = 12
_MEDIA = "media_id long, width int, height int, pixels binary"
_BITS = ("b0", "b1", "b2", "b3")
_CORNERS = ("x", "y", "angle", "scale", *_BITS)
_ROWS = "media_id long, k1 long, k2 long, x array<float>, y array<float>, angle array<float>, scale array<float>, b0 array<long>, b1 array<long>, b2 array<long>, b3 array<long>"


# --- images for the query -------------------------------------------------------------------------------------------


def waves(n: int, side: int = SIDE) -> np.ndarray:
    """n plane waves over a square, as rows."""
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:side, 0:side].reshape(2, -1).astype(np.float32)
    out = np.empty((n, side * side), np.float32)
    for k in range(n):
        turn, freq, phase = rng.uniform(0, 2 * np.pi), rng.uniform(0.08, 0.7), rng.uniform(0, 2 * np.pi)
        out[k] = np.cos(freq * (np.cos(turn) * x + np.sin(turn) * y) + phase)
    return out


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop of up to a fifth on each axis, dimmed and brightened; every second one also turned by a right angle."""
    rng = np.random.default_rng(seed)
    h, w = image.shape
    top, left = rng.integers(0, h // 8, 2)
    part = image[top : h - rng.integers(0, h // 12), left : w - rng.integers(0, w // 12)]
    part = np.clip(part * rng.uniform(0.75, 0.95) + rng.uniform(5, 25), 0, 255).round().astype(np.uint8)
    return np.ascontiguousarray(np.rot90(part) if seed // 10 % 2 else part)


def rendered(embeddings: DataFrame, copy_every: int = 10) -> DataFrame:
    """media_id, width, height, pixels (grey, row by row). Null vectors give null images; missing values count as 0."""

    def make(batches):
        basis = waves(64)
        for batch in batches:
            out = []
            for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec is None or values is None:
                    out.append((None if vec is None else 2 * vec, None, None, None))
                    continue
                v = np.nan_to_num(np.array([x or 0.0 for x in values], np.float32))
                if len(v) > len(basis):
                    basis = waves(len(v))
                flat = v @ basis[: len(v)]
                spread = float(flat.std()) or 1.0
                image = np.clip(128 + 50 * flat / spread, 0, 255).round().astype(np.uint8).reshape(SIDE, SIDE)
                out.append((2 * vec, SIDE, SIDE, image.tobytes()))
                if vec % copy_every == 0:
                    e = edited(image, vec)
                    out.append((2 * vec + 1, e.shape[1], e.shape[0], e.tobytes()))
            for lo in range(0, len(out), 512):
                ids, w, h, p = zip(*out[lo : lo + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.binary())], ["media_id", "width", "height", "pixels"])

    return small_batches(embeddings.select("vec_id", "embedding")).mapInArrow(make, _MEDIA)


# --- corners and descriptors ----------------------------------------------------------------------------------------


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2 r + 1) squares, edges repeated; of a stack of images."""
    p = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1, dtype=np.float64).cumsum(2)
    k = 2 * r + 1
    return ((p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]) / (k * k)).astype(np.float32)


def _scaled(a: np.ndarray, s: float) -> np.ndarray:
    """A stack of images reduced by s, read between pixels."""
    if s == 1.0:
        return a
    h, w = (int(n / s) for n in a.shape[1:])
    y, x = np.minimum((np.arange(h) + 0.5) * s - 0.5, a.shape[1] - 1.001), np.minimum((np.arange(w) + 0.5) * s - 0.5, a.shape[2] - 1.001)
    a = _box(a, 1)
    i, j = y.astype(int), x.astype(int)
    fy, fx = (y - i)[None, :, None].astype(np.float32), (x - j)[None, None, :].astype(np.float32)
    top = a[:, i][:, :, j] * (1 - fx) + a[:, i][:, :, j + 1] * fx
    return top * (1 - fy) + (a[:, i + 1][:, :, j] * (1 - fx) + a[:, i + 1][:, :, j + 1] * fx) * fy


def _cornerness(a: np.ndarray) -> np.ndarray:
    """Harris response at local maxima away from the border; zero elsewhere."""
    gy, gx = np.zeros_like(a), np.zeros_like(a)
    gy[:, 1:-1], gx[:, :, 1:-1] = a[:, 2:] - a[:, :-2], a[:, :, 2:] - a[:, :, :-2]
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    top = r
    for axis in (1, 2):
        top = np.maximum.reduce([np.roll(top, k, axis) for k in (-2, -1, 0, 1, 2)])
    r[(r < top) | (r <= 0)] = 0
    m = _MARGIN
    r[:, :m], r[:, -m:], r[:, :, :m], r[:, :, -m:] = 0, 0, 0, 0
    return r


def _tests() -> np.ndarray:
    """The pairs of points that the bits compare, before any turn: (bit, first or second, y or x)."""
    return np.clip(np.random.default_rng(17).normal(0, 6.0, (BITS, 2, 2)), -7.5, 7.5).astype(np.float32)


def _between(a: np.ndarray, img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a stack of images between pixels."""
    i, j = y.astype(np.int32), x.astype(np.int32)  # never negative
    fy, fx = y - i, x - j
    width = a.shape[2]
    at, flat = (img * a.shape[1] + i) * width + j, a.reshape(-1)
    top = flat[at] * (1 - fx) + flat[at + 1] * fx
    at += width
    return top * (1 - fy) + (flat[at] * (1 - fx) + flat[at + 1] * fx) * fy


def _strongest(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(image, place) of the `most` largest positive responses of each image, equal ones in the order of places."""
    img, at = np.nonzero(r.reshape(len(r), -1) > 0)
    order = np.lexsort((at, -r.reshape(len(r), -1)[img, at], img))
    img, at = img[order], at[order]
    nth = np.arange(len(img)) - np.searchsorted(img, img)
    return img[nth < most], at[nth < most]


def described(images: np.ndarray, tests: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per image of a stack of equal shape: x, y, angle, scale (float arrays) and bits (corner x BITS)."""
    yy, xx = np.mgrid[-7:8, -7:8]
    disc = (yy * yy + xx * xx <= 56).astype(np.float32)
    area = max(1.0, images.shape[1] * images.shape[2] / SIDE**2)
    found = []
    for s, corners in SCALES.items():
        a = _scaled(images.astype(np.float32), s)
        if min(a.shape[1:]) <= 2 * _MARGIN + 1:
            continue
        img, at = _strongest(_cornerness(a), round(corners * area))
        if not len(img):
            continue
        y, x = at // a.shape[2], at % a.shape[2]
        patch = a[img[:, None, None], y[:, None, None] + yy, x[:, None, None] + xx] * disc
        angle = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
        c, n, y0, x0 = (v.astype(np.float32)[:, None, None] for v in (np.cos(angle), np.sin(angle), y, x))
        ty, tx = y0 + c * tests[..., 0] + n * tests[..., 1], x0 + c * tests[..., 1] - n * tests[..., 0]
        value = _between(_box(a, 1), img[:, None, None], ty, tx)
        found.append((img, (x + 0.5) * s, (y + 0.5) * s, angle, np.full(len(img), s), value[..., 0] < value[..., 1]))
    if not found:
        return [(np.zeros(0),) * 4 + (np.zeros((0, BITS), bool),)] * len(images)
    img, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(img, kind="stable")
    bounds = np.searchsorted(img[order], np.arange(len(images) + 1))
    rest = [c[order] for c in rest]
    return [tuple(c[lo:hi] for c in rest) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def described_images(media: DataFrame) -> DataFrame:
    """A row for each image: a name (k1, k2) of its pixels, and its corners as arrays. All null where there is no image."""
    kinds = [pa.int64()] * 2 + [pa.list_(pa.float32())] * 4 + [pa.list_(pa.int64())] * 4

    def columns(ids, names, got) -> pa.RecordBatch:
        """Arrays flat over all images; an image without pixels has neither name nor corners."""
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(g[0]) for g in got]))).astype(np.int32))
        flat = [np.concatenate([g[c] for g in got]).astype(np.float32) for c in range(4)]
        longs = np.packbits(np.concatenate([g[4] for g in got]), axis=1).view("<i8")
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (*flat, *np.ascontiguousarray(longs.T))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([k[i] for k in names], pa.int64()) for i in (0, 1)), *lists], ["media_id", "k1", "k2", *_CORNERS])

    def make(batches):
        tests = _tests()
        for batch in batches:
            nothing, by_shape = [], {}
            for media_id, w, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if media_id is None or not p or not w or not h or len(p) != w * h:
                    nothing.append(media_id)
                else:
                    by_shape.setdefault((h, w), []).append((media_id, p))
            if nothing:
                yield pa.RecordBatch.from_arrays([pa.array(nothing, pa.int64()), *(pa.nulls(len(nothing), k) for k in kinds)], ["media_id", "k1", "k2", *_CORNERS])
            for (h, w), some in by_shape.items():
                step = max(1, (1 << 18) // (h * w))
                for lo in range(0, len(some), step):
                    ids, pixels = zip(*some[lo : lo + step], strict=True)
                    stack = np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for p in pixels])
                    names = [np.frombuffer(xxhash.xxh3_128_digest(p + bytes(f"{w}x{h}", "ascii")), "<i8").tolist() for p in pixels]
                    yield columns(ids, names, described(stack, tests))

    return small_batches(media.select("media_id", "width", "height", "pixels")).mapInArrow(make, _ROWS)


def corners_of(media: DataFrame) -> DataFrame:
    """A row for each corner; a row with a null corner for an image without any."""
    one = described_images(media).select("media_id", "k1", "k2", F.posexplode_outer(F.arrays_zip(*_CORNERS)).alias("corner", "_c"))
    return one.select("media_id", "k1", "k2", "corner", *[F.col(f"_c.{c}").alias(c) for c in _CORNERS])


# --- tables, near classes and votes ------------------------------------------------------------------------------------


def _keyed(rows: DataFrame, tables, *names: str) -> DataFrame:
    """(names, key): the distinct keys of an image's corners, hashes of a table's number and its runs of 32 bits."""
    run = lambda z, t: F.shiftrightunsigned(z[f"b{t // 2}"], 32 * (t % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    of = lambda n, runs: F.transform(F.arrays_zip(*_BITS), lambda z: F.xxhash64(F.lit(n), *[run(z, t) for t in runs]))
    return rows.select(*names, F.explode(F.array_distinct(F.flatten(F.array(*[of(n, runs) for n, runs in enumerate(tables)])))).alias("key"))


def votes_of(q: list[np.ndarray], c: list[np.ndarray], hamming: int = HAMMING) -> int:
    """The query corners that agree on one similarity transform, over two offset grids of transforms. q, c: x, y, angle, scale, bits as four longs."""
    apart = np.bitwise_count(q[4][:, None] ^ c[4][None]).sum(2)
    i, j = np.nonzero(apart <= hamming)
    if len(i) < 2:
        return len(i)
    turn = (q[2][i] - c[2][j]) % (2 * np.pi)
    f = q[3][i] / c[3][j]
    tx = q[0][i] - f * (np.cos(turn) * c[0][j] - np.sin(turn) * c[1][j])
    ty = q[1][i] - f * (np.sin(turn) * c[0][j] + np.cos(turn) * c[1][j])
    best = 0
    for grid in (0.0, 0.5):
        cell = [np.floor(turn / (np.pi / 8) + grid) % 16, np.round(np.log2(f) * 2), np.floor(tx / 14 + grid), np.floor(ty / 14 + grid)]
        t, u, v, w = (c.astype(np.int64) for c in cell)
        name = ((t * 64 + u + 32) * 65536 + v + 32768) * 65536 + w + 32768
        of = np.unique(np.stack([name, i]), axis=1)[0]  # a query corner counts once
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        best = max(best, int(np.diff(first).max()))
    return best


def _compared(pairs: DataFrame, images: DataFrame, hamming: int) -> DataFrame:
    """(q, c, votes) of pairs of classes, on all their corners."""
    side = lambda name: images.select(F.col("c").alias(name), *[F.col(v).alias(f"{name}_{v}") for v in _CORNERS])

    def corners(batch: pa.RecordBatch, name: str):
        lists = [batch.column(f"{name}_{v}") for v in _CORNERS]
        at = lists[0].offsets.to_numpy()
        flat = [v.values.to_numpy() for v in lists]
        flat = [*(v.astype(float) for v in flat[:4]), np.stack(flat[4:], 1).view(np.uint64)]
        return [[v[lo:hi] for v in flat] for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def compare(batches):
        for batch in batches:
            votes = [votes_of(a, b, hamming) for a, b in zip(corners(batch, "q"), corners(batch, "c"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("c"), pa.array(votes, pa.int32())], ["q", "c", "votes"])

    pairs = written(pairs, "image-pairs")
    asked = side("q").join(small(pairs.select("q").distinct()), "q", "left_semi")
    return small_batches(side("c").join(small(pairs), "c").join(asked, "q")).mapInArrow(compare, "q long, c long, votes int")


def near_classes(images: DataFrame, hamming: int = HAMMING, votes: int = NEAR_VOTES, passes: int = PASSES) -> DataFrame:
    """(c, root) of the classes that join another's near class; every root was compared with the class. images: c, asked, corners.

    In a pass each class that shares SHARED keys or more with a bucket's centre is compared with the centre that it shares the most with. Who agrees points to it; pointers
    lead up to classes of more company, and what is at their end is compared with all that lead there. A class that joins none in any pass stays a centre: the search then
    meets it like all others."""
    keys = _keyed(images, NEAR_TABLES, "c", "asked")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "n")
    buckets = written(keys.join(sizes, "key"), "image-buckets")
    joined = images.select("c", F.col("c").alias("root")).where("false")
    for _ in range(passes):
        live = buckets.join(small(joined.select("c")), "c", "left_anti")
        rows = live.join(live.groupBy("c").agg(F.sum("n").alias("company")), "c")
        top = F.max(F.struct((~F.col("asked")).alias("free"), "company", (-F.col("c")).alias("minus")))
        centres = rows.groupBy("key").agg(top.alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
        shared = live.select("key", "c").join(centres, "key").where("c <> centre").groupBy("c", "centre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
        best = shared.groupBy(F.col("c").alias("q")).agg((-F.max(F.struct("n", (-F.col("centre")).alias("minus")))["minus"]).alias("c"))
        agree = lambda pairs: _compared(pairs, images, hamming).where(F.col("votes") >= votes).select("q", "c")
        up = written(agree(best), "image-stars")
        step = up.select(F.col("q").alias("c"), F.col("c").alias("next"))
        end = up
        for _ in range(JUMPS):  # twice as far each time
            end = end.join(step, "c", "left").select("q", F.coalesce("next", "c").alias("c"))
            step = end.select(F.col("q").alias("c"), F.col("c").alias("next"))
        end = written(end.join(small(up.select(F.col("q").alias("c"))), "c", "left_anti").select("q", "c"), "image-ends")
        new = end.join(up, ["q", "c"], "left_semi").union(agree(end.join(up, ["q", "c"], "left_anti")))
        joined = written(joined.union(new.select(F.col("q").alias("c"), F.col("c").alias("root"))), "image-roots")
    return joined


def copies(media: DataFrame, query_every: int = QUERY_EVERY, votes: int = VOTES, hamming: int = HAMMING) -> DataFrame:
    """media_id, class_id (the smallest id of equal images), near_id (the class_id of the near class's centre), is_query, matches (class_ids of
    the centres that a query's image was found to be a copy of or copied to; null for others) of every row."""
    rows = written(described_images(media), "corners")
    images = rows.select("media_id", "k1", "k2")
    named = images.where("k1 is not null and media_id is not null")
    classes = written(named.groupBy("k1", "k2").agg(F.min("media_id").alias("class_id"), F.max(F.col("media_id") % query_every == 0).alias("asked")), "classes")
    firsts = rows.where("size(x) > 0").withColumnRenamed("media_id", "class_id").join(classes, ["k1", "k2", "class_id"]).dropDuplicates(["k1", "k2"])
    reps = written(firsts.select(F.col("k1").alias("c"), "class_id", "asked", *_CORNERS), "image-classes")
    joined = near_classes(reps, hamming)
    asking = _keyed(reps.where("asked").withColumnRenamed("c", "q"), TABLES, "q")
    centres = _keyed(reps.join(small(joined.select("c")), "c", "left_anti"), TABLES, "c")
    met = centres.join(small(written(asking, "query-keys"), 1 << 20), "key").where("q <> c").select("q", "c").distinct()
    own = joined.select(F.col("c").alias("q"), F.col("root").alias("c"))
    found = _compared(met.join(own, ["q", "c"], "left_anti"), reps, hamming).where(F.col("votes") >= votes).select("q", "c")
    id_of = reps.select("c", "class_id")
    links = found.union(own.join(reps.where("asked").select(F.col("c").alias("q")), "q")).join(id_of, "c").groupBy("q").agg(F.array_sort(F.collect_set("class_id")).alias("found"))
    near = joined.join(id_of.select(F.col("c").alias("root"), F.col("class_id").alias("root_id")), "root").select(F.col("c").alias("k1"), "root_id")
    of_class = classes.join(near, "k1", "left").join(links.withColumnRenamed("q", "k1"), "k1", "left").select("k1", "k2", "class_id", F.coalesce("root_id", "class_id").alias("near_id"), "found")
    out = images.join(of_class, ["k1", "k2"], "left")
    is_query = F.coalesce(F.col("media_id") % query_every == 0, F.lit(False))
    return out.select("media_id", "class_id", "near_id", is_query.alias("is_query"), F.when(is_query, F.coalesce("found", F.array().cast("array<long>"))).alias("matches"))


def op8_image_copies(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return copies(rendered(vectors.repartition(max(vectors.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))))  # images take forty times a vector's bytes and far more work
