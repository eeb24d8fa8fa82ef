import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import sharding


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randrange(0, 400)))) for i in range(1500)]
    rows += [(2000 + i, "the same text in a third of the rows") for i in range(700)]
    rows += [(4000 + i, f"pair {i // 2} " * 5) for i in range(60)]
    return [*rows, (9000, None), (9001, ""), (9002, "z" * 200_000), (None, "no id"), (9003, "twice"), (9003, "twice")]


def check(rows, corpus, shards):
    assert len(rows) == len(corpus)
    size = {i: len((t or "").encode()) + 16 for i, t in corpus}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in corpus}
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], crc[r.doc_id], "bytes", None)
        slots[r["shard"]].append(r.slot)
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    return total


def test_near_equal_sizes(spark, documents, corpus):
    small = [r for r in corpus if r[0] != 9002]
    total = check(sharding.sharded(documents(small), 10).collect(), small, 10)
    mean = sum(total.values()) / 10
    assert max(abs(t - mean) for t in total.values()) <= 0.05 * mean + 1200


def test_oversized_record(spark, documents, corpus):
    check(sharding.sharded(documents(corpus), 10).collect(), corpus, 10)


def test_small_groups_stay_together(spark, documents, corpus):
    got = defaultdict(set)
    for r in sharding.sharded(documents(corpus), 10).collect():
        if r.doc_id is not None and 4000 <= r.doc_id < 4060:
            got[(r.doc_id - 4000) // 2].add(r["shard"])
    assert all(len(s) == 1 for s in got.values())


def test_overfull_ranges_are_subdivided(spark, documents, corpus, monkeypatch):
    rows = sharding.keyed(documents(corpus))
    total = rows.agg({"size": "sum"}).first()[0]
    monkeypatch.setattr(sharding, "PER_RANGE", 0.2)
    few = sharding._quantiles(sharding._sample(rows, 0.2 * 50 / total, 11), 50)
    _, stats = sharding.split_ranges(rows, 50, total)
    assert stats.count() > len(few) + 1


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, documents, n):
    rows = sharding.sharded(documents(["a", "b", "c"][:n])).collect()
    assert len(rows) == n
    assert len({(r["shard"], r.slot) for r in rows}) == n


def test_reruns_agree(spark, documents, corpus):
    a, b = ({(r.doc_id, r["shard"], r.slot) for r in sharding.sharded(documents(c), 7).collect() if r.doc_id != 9003} for c in (corpus, corpus[::-1]))
    assert a == b


def test_groups_of_equal_texts_stay_whole(spark, documents, corpus):
    """All groups but the one that is larger than a shard, next to sizes within a sixty-fourth of the mean and a record."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 300)))) for i in range(4000)]
    rows += [(10_000 + i, f"group {i % 37} " * (3 + i % 37)) for i in range(900)]
    rows += [(20_000 + i, "larger than a shard all together " * 4) for i in range(900)]
    out = sharding.sharded(documents(rows), 10).collect()
    total = check(out, rows, 10)
    mean = sum(total.values()) / 10
    assert max(abs(t - mean) for t in total.values()) <= mean / 64 + 316
    where, text = defaultdict(set), dict(rows)
    for r in out:
        where[text[r.doc_id]].add(r["shard"])
    assert [t for t, s in where.items() if len(s) > 1] == ["larger than a shard all together " * 4]


def test_placed_first_levels_the_shards():
    whole, dealt, ends = sharding.placed_first([("a", 30, 1), ("b", 20, 2), ("c", 200, 5), ("d", 5, 1)], 4, 400)
    assert (dict(whole), dealt) == ({"a": 0, "b": 1, "d": 2}, ["c"])
    assert ends == [70, 150, 245, 345]
    assert sharding.placed_first([("a", 300, 1)], 4, 400)[2] == [0, 33, 67, 100]
    assert sharding.placed_first([], 3, 0)[2] == [0, 0, 0]


def test_empty_table(spark, documents):
    assert sharding.sharded(documents([])).count() == 0


def test_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(["a", "b", "b"]).withColumns({c: F.lit("x") for c in ("size", "key", "same", "shard", "range", "own", "weight", "at", "slot", "to")})
    rows = sharding.sharded(docs, 2).collect()
    assert sorted((r["shard"], r.slot) for r in rows if r.doc_id > 0) in ([(0, 0), (0, 1)], [(1, 0), (1, 1)], [(0, 1), (0, 2)], [(1, 1), (1, 2)])
