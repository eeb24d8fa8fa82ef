import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import neardup
from tessera.llm.common import Words, shingle_hashes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(texts, percent=85):
    """{doc: (set size, component)} by comparing all pairs."""
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in range(len(texts))}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c d e", "a b c d e f", "ÄÖ x y z w", "äö x y z w"]
    for size, copies, edits in ((120, 40, 3), (300, 25, 7), (60, 20, 2), (9, 6, 1)):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(edits + 1)) for _ in range(copies)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts.append(" ".join(f"v{i}" for i in range(60_000)))
    texts += [texts[20]] * 30
    rng.shuffle(texts)
    return texts


def test_brute_force(spark, documents, corpus):
    want = brute_force(corpus)
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(corpus)).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_nulls_and_repeated_rows(spark, documents):
    rows = [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f"), (3, "other words here for once now"), (3, "a b c d e f")]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect())
    assert got == [(-1, 0, None, True), (-1, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (9, 2, 3, False)]


def test_empty_table(spark, documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["a b c", "a b c"]).withColumns({"keys": F.lit(1), "node": F.lit(2), "component": F.lit(3), "sig": F.lit(4)})
    assert [r.component_id for r in neardup.near_duplicates(docs).collect()] == [0, 0]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (200, 200)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_densification_fills_every_bin():
    minima, filled = np.zeros((2, 160), np.uint64), np.zeros((2, 160), bool)
    minima[0, 7], filled[0, 7] = 5, True
    minima[1, [1, 2]], filled[1, [1, 2]] = [8, 9], True
    out = neardup.densified(minima, filled)
    assert set(out[0]) == {5}
    assert set(out[1]) == {8, 9}
    assert 40 < (out[1] == 8).sum() < 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\tÄé.", max_size=40), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    hashes, bounds = Words().of_texts([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        mine = hashes[bounds[i] : bounds[i + 1]]
        assert len(mine) == len(words)
        for h, w in zip(mine.tolist(), words, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_words_across_blocks():
    text = ("ab " * 500_000 + "c" * 3_000_000 + " d").encode()
    hashes, _ = Words().of(text)
    assert len(hashes) == 500_002
    assert len(set(hashes.tolist())) == 3


def test_short_sequences_differ():
    w, _ = Words().of(b"a b c d e f")
    assert len({int(shingle_hashes(w[:k])[0]) for k in range(1, 6)}) == 5
    assert len(shingle_hashes(w)) == 2


def template_family(rng, partners, n_words, own, shared, members=2):
    """Texts from one template: each changes `own` words to new ones; the members of a group of partners change `shared` more alike."""
    base = [f"t{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(partners):
        alike = {p: f"p{rng.randrange(10**9)}" for p in rng.sample(range(n_words), shared)}
        for _ in range(members):
            words = list(base)
            for p in rng.sample(range(n_words), own):
                words[p] = f"o{rng.randrange(10**9)}"
            for p, w in alike.items():
                words[p] = w
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def exhaustive(texts, percent):
    """Components by all pairs, as one matrix product."""
    index, rows, cols, sizes = {}, [], [], []
    for i, t in enumerate(texts):
        s = shingles(t)
        sizes.append(len(s))
        for x in s:
            rows.append(i)
            cols.append(index.setdefault(x, len(index)))
    held = np.bincount(cols)
    rows, cols, sizes = np.array(rows), np.array(cols), np.array(sizes)
    common = np.zeros((len(texts), len(texts)), np.float32)
    wide = np.flatnonzero(held > 1)
    for lo in range(0, len(wide), 4096):
        place = np.full(len(held), -1)
        place[wide[lo : lo + 4096]] = np.arange(len(wide[lo : lo + 4096]))
        m = np.zeros((len(texts), len(wide[lo : lo + 4096])), np.float32)
        ok = place[cols] >= 0
        m[rows[ok], place[cols[ok]]] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None] - common
    label = np.arange(len(texts))
    i, j = np.nonzero(np.triu(100 * common >= percent * union, 1))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("partners", "own", "shared"), [(600, 9, 2), (500, 9, 5)])
def test_template_family_keeps_every_link(spark, documents, monkeypatch, partners, own, shared):
    """Hundreds of near misses around every link: of one template, in whose family all documents share many buckets."""
    texts = template_family(random.Random(own * shared), partners, 1204, own, shared)
    monkeypatch.setattr(neardup, "BLOCK", 500)
    monkeypatch.setattr(neardup, "SET_BLOCK", 1 << 18)
    want = exhaustive(texts, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert len(set(want.tolist())) < len(texts) - partners // 2


def test_blocks_of_sets_equal_plain_sets():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.choice(10**6, 60, False)
    sets = [np.unique(np.concatenate((rng.choice(base, 55, False), rng.choice(10**6, k % 9)))) for k in range(80)]
    comp = np.arange(80) // 2
    t = pa.table({"node": np.arange(80) * 7, "component": comp, "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    out = neardup._by_sets(85)(t)
    label = {k: k for k in range(0, 560, 7)}
    for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True):
        label[b] = a
    links = [(a, b) for a in range(80) for b in range(a) if comp[a] != comp[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert links
    top = {k: k for k in range(80)}
    for _ in range(80):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert {k // 7: v // 7 for k, v in label.items()} == top


def _kernel_rows(n, blocks, words=20):
    """Footers of 20 words with one varying word, as the block comparisons get them; every 50th is a copy of the one before but for its name."""
    import random

    import pyarrow as pa

    from tessera.llm.common import Words

    rng = random.Random(2)
    base, maker = [f"w{k}" for k in range(words)], Words()
    texts = []
    for k in range(n):
        t = list(base)
        t[0 if k % 3 else rng.randrange(words)] = f"x{k}"
        texts.append(texts[-1] if k % 50 == 49 else " ".join(t).encode())
    sets = neardup._sets(texts, maker)
    sig = neardup.signatures(sets, 160)
    short = (neardup.mixed(sig) >> np.uint64(56)).astype(np.uint8)
    block = np.array([k * blocks // n for k in range(n)], np.int32)
    table = pa.table(
        {
            "node": np.arange(n), "component": np.arange(n), "block": block, "n_shingles": np.array([len(s) for s in sets]), "sig": [x.tobytes() for x in short],
            "shingles": [s.view(np.int64) for s in sets],
        }
    )
    return table, sets


@pytest.mark.parametrize("blocks", [1, 2])
def test_block_comparisons_are_whole(blocks):
    table, sets = _kernel_rows(700, blocks)
    own = [set(s.tolist()) for s in sets]
    block = table["block"].to_numpy()
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if (blocks == 1 or block[i] != block[j]) and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])}
    got = neardup._by_sets(85)(table)
    edges = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))

    def classes(pairs):
        label = list(range(700))

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            label[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(700)]

    assert want and classes(edges) == classes(want)
    close = neardup._by_bytes(160, 85)(table)
    assert close.num_rows <= 700 * 3


def test_block_comparisons_have_bounded_memory():
    """Two full blocks of short near misses, all of which pass the first comparison or none: no array is rows by rows of both blocks."""
    import tracemalloc

    table, _ = _kernel_rows(2 * neardup.BLOCK, 2)
    for kernel in (neardup._by_sets(85), neardup._by_bytes(160, 40)):
        tracemalloc.start()
        kernel(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400 << 20


def test_blocks_hold_few_rows(spark):
    rows = spark.range(10_000).selectExpr("id as node", "0L as family", "id % 7 as component", "if(id % 100 = 0, 300000L, 5L) as n_shingles")
    sizes = neardup._in_blocks(rows, "family", "n_shingles", neardup.SET_BLOCK).groupBy("block").agg({"node": "count", "n_shingles": "sum"}).collect()
    assert all(r["count(node)"] <= neardup.BLOCK + 1 and r["sum(n_shingles)"] <= neardup.SET_BLOCK + 300_000 for r in sizes)
