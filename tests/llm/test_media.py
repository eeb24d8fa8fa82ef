import numpy as np
import pytest

from tessera.llm import media


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 64)).astype(np.float32)
    vecs[50:60] = vecs[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vecs)] + [(200, None, 0), (None, vecs[0].tolist(), 0), (201, [], 0), (202, [None] * 64, 0)]
    return media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).cache()


def test_edited_copies_are_found_and_nothing_else(images):
    out = {r.media_id: r for r in media.copies(images).collect() if r.media_id is not None}
    asked = [i for i, r in out.items() if r.is_query and i < 240]
    assert sorted(asked) == list(range(0, 240, 20))
    found = [i + 1 in out[i].matches for i in asked]
    assert np.mean(found) >= 0.9
    assert all(set(out[i].matches) <= {i + 1} for i in asked)
    assert {out[2 * i].class_id for i in range(50, 60)} == {100}
    assert out[400].class_id is None
    assert out[400].matches == []


def brute_force(images):
    """Every query against every image: all descriptor pairs, then a vote on the shift after undoing turn and scale."""
    rows = media.corners_of(images).where("corner is not null").collect()
    by = {}
    for r in rows:
        by.setdefault(r.media_id, []).append(r)
    bits = {i: np.unpackbits(np.array([[r.b0, r.b1, r.b2, r.b3] for r in c], "<i8").view(np.uint8), axis=1) for i, c in by.items()}
    pairs = set()
    for q in (i for i in by if i % 20 == 0):
        for c in by:
            if c == q or bits[q].tobytes() == bits[c].tobytes():
                continue
            near = np.argwhere((bits[q][:, None] != bits[c][None]).sum(2) <= media.HAMMING)
            shifts = []
            for a, b in near:
                x, y = by[q][a], by[c][b]
                t, f = x.angle - y.angle, x["scale"] / y["scale"]
                shifts.append((a, round(t % (2 * np.pi), 1), x.x - f * (np.cos(t) * y.x - np.sin(t) * y.y), x.y - f * (np.sin(t) * y.x + np.cos(t) * y.y)))
            if any(len({s[0] for s in shifts if np.hypot(s[2] - o[2], s[3] - o[3]) < 7}) >= media.VOTES for o in shifts):
                pairs.add((q, c))
    return pairs


def test_recall_against_brute_force(images):
    some = images.where("media_id < 240 and media_id not between 100 and 119")
    want = brute_force(some)
    got = {(r.media_id, c) for r in media.copies(some).where("is_query").collect() for c in r.matches}
    assert len(want) >= 8
    assert len(got & want) >= 0.9 * len(want)


def test_turns_keep_descriptors():
    image = media.waves(8).sum(0).reshape(media.SIDE, media.SIDE)
    image = (128 + 12 * image).clip(0, 255).round()
    a, b = (media.described(np.stack([x]), media._tests())[0] for x in (image, np.rot90(image)))
    first = [set(map(bytes, np.packbits(x[4][x[3] == 1.0], axis=1))) for x in (a, b)]
    assert len(first[0] & first[1]) >= 4


def test_odd_images(spark):
    flat, tiny = bytes([7]) * 2500, bytes(range(25))
    rows = [(20, 50, 50, flat), (40, 50, 50, flat), (60, 5, 5, tiny), (80, 50, 50, b"short"), (100, None, None, None), (None, 5, 5, tiny), (120, 0, 0, b"")]
    out = {r.media_id: (r.class_id, r.matches) for r in media.copies(spark.createDataFrame(rows, media._MEDIA)).collect()}
    assert out == {20: (20, []), 40: (20, []), 60: (60, []), 80: (None, []), 100: (None, []), None: (None, None), 120: (None, [])}


def test_empty_table(spark):
    assert media.copies(spark.createDataFrame([], media._MEDIA)).count() == 0


def test_the_rendered_images_are_the_smooth_ones_too():
    """Frequencies span 0.08 to 0.7 a pixel: no wave changes faster, and some change slowly."""
    w = media.waves(64).reshape(64, media.SIDE, media.SIDE)
    steep = np.maximum(np.abs(np.diff(w, axis=1)).max((1, 2)), np.abs(np.diff(w, axis=2)).max((1, 2)))
    assert steep.max() <= 0.7
    assert steep.min() < 0.15


def warped(a, scale, degrees):
    """An image resized and turned about its middle, read between pixels."""
    t, h = np.radians(degrees), a.shape[0]
    n = int(h * scale)
    y, x = (np.mgrid[0:n, 0:n] - (n - 1) / 2) / scale
    y, x = (h - 1) / 2 + y * np.cos(t) - x * np.sin(t), (h - 1) / 2 + y * np.sin(t) + x * np.cos(t)
    y, x = np.clip(y, 0, h - 1.001), np.clip(x, 0, h - 1.001)
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    a = a.astype(float)
    return (a[i, j] * (1 - fx) + a[i, j + 1] * fx) * (1 - fy) + (a[i + 1, j] * (1 - fx) + a[i + 1, j + 1] * fx) * fy


EDITS = {
    "crop to 60 %": (0.9, lambda a, rng: a[10:86, 20:90]), "noise": (0.9, lambda a, rng: a + rng.normal(0, 5, a.shape)), "gamma": (0.9, lambda a, rng: 255 * (a / 255.0) ** 0.7),
    "turn by 20": (0.9, lambda a, rng: warped(a, 1, 20)), "turn by 45": (0.9, lambda a, rng: warped(a, 1, 45)), "enlarged": (0.9, lambda a, rng: warped(a, 1.25, 0)),
    "enlarged by half": (0.9, lambda a, rng: warped(a, 1.5, 0)), "reduced by a fifth": (0.5, lambda a, rng: warped(a, 0.8, 0)),
}


def test_recall_of_other_edits(spark, images):
    """Query 20 k against one edit of its image among 240 unrelated ones."""
    rng = np.random.default_rng(4)
    plain = [r for r in images.where("media_id < 240 and media_id % 2 = 0").collect() if not 100 < r.media_id < 120]
    rows, want = [], {}
    for r in plain:
        a = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width)
        rows.append((r.media_id * 1000, r.width, r.height, bytes(r.pixels)))
        for k, (name, (_, edit)) in enumerate(EDITS.items()):
            b = np.ascontiguousarray(np.clip(edit(a, rng), 0, 255).round().astype(np.uint8))
            if min(b.shape) > 30:
                rows.append((r.media_id * 1000 + 2 * k + 1, b.shape[1], b.shape[0], b.tobytes()))
                want[r.media_id * 1000, r.media_id * 1000 + 2 * k + 1] = name
    out = {r.media_id: r for r in media.copies(spark.createDataFrame(rows, media._MEDIA), query_every=1000).collect()}
    found = {name: [] for name in EDITS}
    for (q, c), name in want.items():
        found[name].append(out[c].near_id == out[q].near_id or out[c].near_id in out[q].matches)
    assert all(r.near_id // 1000 == r.media_id // 1000 for r in out.values())
    assert all(m // 1000 == q // 1000 for q, r in out.items() if r.matches for m in r.matches)
    assert {name: np.mean(f) for name, f in found.items() if np.mean(f) < EDITS[name][0]} == {}


def test_a_group_of_nearly_equal_images_is_one_near_class(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    vecs = [base + rng.normal(0, 0.08, 64) for _ in range(120)] + [rng.normal(size=64) for _ in range(40)]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(vecs)]
    out = {r.media_id: r for r in media.copies(media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).collect()}
    pairs = [(q, c) for q in range(0, 240, 20) for c in range(0, 240, 2) if q != c]
    found = [out[c].near_id == out[q].near_id or out[c].near_id in out[q].matches for q, c in pairs]
    assert np.mean(found) >= 0.95
    assert all(m < 240 for q in range(0, 240, 20) for m in out[q].matches)
    assert sum(len(r.matches) for r in out.values() if r.matches) < 300
    edited = [out[c].near_id == out[q].near_id or out[c].near_id in out[q].matches for q in range(0, 240, 20) for c in range(1, 240, 20)]
    assert np.mean(edited) >= 0.9


def test_corners_of_equal_strength_come_in_the_order_of_places():
    r = np.zeros((2, 4, 4), np.float32)
    r[0, [0, 1, 3], [3, 2, 0]] = 5
    r[1, 2, 2], r[1, 0, 1] = 1, 2
    img, at = media._strongest(r, 2)
    assert (img.tolist(), at.tolist()) == ([0, 0, 1, 1], [3, 6, 1, 10])
    tiled = np.tile(np.random.default_rng(1).integers(0, 255, (24, 24)), (4, 4)).astype(np.uint8)
    one, two = (media.described(np.stack([tiled] * n), media._tests())[0] for n in (1, 3))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_repeated_rows_and_clashing_columns(images):
    from pyspark.sql import functions as F

    some = images.where("media_id < 60")
    twice = some.union(some).withColumns({c: F.lit("x") for c in ("c", "q", "x", "key", "class_id", "near_id", "found", "votes", "asked", "b0")})
    once = {r.media_id: tuple(r) for r in media.copies(some).collect()}
    rows = [tuple(r) for r in media.copies(twice).collect()]
    assert len(rows) == 2 * len(once)
    assert all(once[r[0]] == r for r in rows)
