"""The trie against a plain one that holds every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, every=100, heads=6):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            convs[conv_id].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    convs = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        giver = c - (abs(c) % every) * (1 if c >= 0 else -1)
        built[c] = convs.get(giver, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(
        (min(who), len(n), min(members[n[:-1]]) if n else -1, len(who), kids[n], leaves[n], saved[n], digest(n)) for n, who in members.items()
    )


def found(spark, rows, every=100, heads=6):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as i", "'x' as key", "2 as total", "3 as path")
    got = prefixes.prefix_trie(*prefixes.rebuilt_turns(prefixes.ordered_turns(df), every, heads))
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def conversations(n, seed, longest=9, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c * 3 % 701, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "ab", "é漢", "x" * 50][:texts + 2])))
    rng.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, None, None, None), (5, 1, "b", "t"), (5, 1, "a", "u"), (5, 1, "a", "u"), (1005, 3, "z", ""), (-7, 1, "user", "n"), (-107, 1, "user", "n")]


def test_brute_force(spark):
    rows = conversations(300, 1) + ODD
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, 10, 3) == plain(rows, 10, 3)


@pytest.mark.parametrize(("segment", "shard"), [(2, 7), (3, 40), (4, 1000), (256, 25)])
def test_segments_and_shards(spark, monkeypatch, segment, shard):
    """Spines over many shards, starts below full segments, copies, and ranges that divide conversations."""
    for name, value in (("SEGMENT", segment), ("SHARD_NODES", shard), ("RANGE_ROWS", 20)):
        monkeypatch.setattr(prefixes, name, value)
    rows = conversations(60, 2, 10, 1)
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(25) for t in range(9)]
    rows += [(3000, t, "user", f"same {t}") for t in range(8)]
    assert found(spark, rows) == plain(rows)


def test_findclose():
    rng = random.Random(4)
    for n in (1, 5, 64, 700, 3000):
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or rng.random() < rng.choice([0.3, 0.5, 0.9])):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        marks = np.array(bits, np.uint8)
        opens = np.flatnonzero(marks)
        assert prefixes.Parentheses(marks).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


def test_no_turns_and_empty(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]  # heads are longer than these, and nobody gives
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
