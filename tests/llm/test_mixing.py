import random
import re
from collections import defaultdict

import pytest

from tessera.llm import mixing


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "D", None, "é"])) for i in range(400)]
    return [*rows, (400, None, "en", "b"), (401, "", "en", "empty"), (402, "x " * 20_000, "en", "b"), (402, "x " * 20_000, "en", "b"), (None, "no id here", "en", "c")]


def wanted(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess again until none is above the cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def seats(targets, names, house):
    """Sainte-Lague by giving out one seat after another."""
    got = dict.fromkeys(names, 0)
    for _ in range(house):
        best = max(names, key=lambda s: (targets[s] / (2 * got[s] + 1), -names.index(s)))
        got[best] += 1
    return got


def test_targets_and_taken(spark, documents, corpus):
    sizes = defaultdict(int)
    for _, t, _, s in corpus:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = wanted(dict(sizes))
    source = {i: s for i, _, _, s in corpus}
    out = mixing.mix(documents(corpus)).collect()
    assert len(out) == len(corpus)
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 2, (s, taken[s], goal)
    assert sorted(map(tuple, mixing.mix(documents(corpus[::-1])).collect()), key=repr) == sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("blocks", "shards"), [(37, 5), (200, 3), (11, 11)])
def test_quotas_are_highest_quotients(spark, documents, corpus, blocks, shards):
    parts = mixing._parts(mixing.sized(documents(corpus)), 2)
    goal = mixing.targets(parts)
    rows = sorted(goal.collect(), key=lambda r: r["rank"])
    names = [r.skey for r in rows]
    total = rows[0].total
    block = max(1, total // blocks)
    got = defaultdict(dict)
    for r in mixing.quotas(goal, blocks, shards).collect():
        got[r["shard"]][r.skey] = r.blocks_so_far
        assert r.blocks >= 0
        assert r.block_tokens == block
    for k in range(shards):
        assert got[k] == seats({r.skey: r.target for r in rows}, names, (total // block) * (k + 1) // shards)


def test_empty_and_wordless(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(documents([None, ""])).collect()] == [(0, 0.0, 0)] * 2


def test_clashing_columns(spark, documents, corpus):
    from pyspark.sql import functions as F

    docs = documents(corpus).withColumns({c: F.lit("x") for c in ("size", "h", "part", "total", "target")})
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] > 0


def test_shards_read_their_quotas(spark, documents, corpus):
    """What all documents of a source give to a shard is the source's quota of blocks there, up to what the cap leaves."""
    docs = documents(corpus)
    source = {i: s for i, _, _, s in corpus}
    got = defaultdict(lambda: [0] * 5)
    for r in mixing.mix(docs, shards=5).collect():
        assert sum(r.reads) == r.taken
        got[source[r.doc_id]] = [a + b for a, b in zip(got[source[r.doc_id]], r.reads, strict=True)]
    goal = mixing.targets(mixing._parts(mixing.sized(docs), 2))
    most = {r.source: r.most for r in goal.collect()}
    for r in mixing.quotas(goal, mixing.BLOCKS, 5).collect():
        before, now = (r.blocks_so_far - r.blocks) * r.block_tokens, r.blocks_so_far * r.block_tokens
        assert got[r.source][r["shard"]] == min(now, most[r.source]) - min(before, most[r.source])
