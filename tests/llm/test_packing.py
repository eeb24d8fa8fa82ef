"""Packing against plain encoding: every id in one piece, sequences without gaps, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing

TEXTS = [
    None, "", "one", "one", "Hello,  world! 123\n\n  x", "tabs\tand odd  blanks \t  here", " <|endoftext|> in  the<|endoftext|>middle ", "word " * 3000, "ß" * 3000,
    "it's we'll I'd 'tis\r\n next", "\n \n", "x" * 20_000,
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(packing.vocabulary())
    return lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 0]


def held(pieces, docs, plain, size, share):
    """docs: (doc_id, text) with different ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc_id, text in docs:
        ids, at = plain(text), 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids == np.array(ids[at : at + p.length], "<u4").tobytes()
            at += p.length
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and {p.padded_to for p in ps} == {at if at & (at - 1) == 0 else size}
        padding, total = padding + ps[0].padded_to - at, total + at
    assert padding <= share * total + size
    return by_seq


def test_brute_force(spark, documents, plain):
    rng = random.Random(7)
    words = ["alpha", "beta", "Straße", "12", "x-y", "\n", "", "gamma"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(150)]
    docs = list(enumerate(texts))
    for size in (64, 1024):
        pieces = packing.packed(documents(docs).repartition(5), size).collect()
        held(pieces, docs, plain, size, 0.02)


def test_same_ids_as_the_vocabulary(plain, sf, monkeypatch):
    import pyarrow.parquet as pq

    rng = random.Random(11)
    ranges = [(9, 127), (1, 0x250), (0x2000, 0x2070), (0x400, 0x3000), (0x1F300, 0x1FA00)]
    odd = ["".join(chr(rng.randint(*rng.choice(ranges[: 1 + k % 5])) - 1) for _ in range(80)) for k in range(400)]
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t] + [t or "" for t in TEXTS] + odd
    encoder = packing.Encoder(packing.vocabulary())
    for t in texts:
        assert encoder.of(t) == np.array(plain(t)[:-1], "<u4").tobytes()
    monkeypatch.setattr(packing, "TEXT_BLOCK", 50)
    assert any(len(list(encoder.slices(t))) > 5 for t in texts)
    for t in texts[-450:] + texts[:50]:
        assert encoder.of(t) == np.array(plain(t)[:-1], "<u4").tobytes()


def slots_cover(packs, counts, size):
    used = defaultdict(list)
    for fill, count, slots in packs:
        assert fill <= size and count > 0
        at = 0
        for rest, rank, start, length, offset in slots:
            assert offset == at
            at += length
            for k in range(count):
                used[rest, rank + k].append((start, length))
        assert at == fill
    assert {(r, k) for r, n in counts.items() for k in range(n)} == set(used)
    for (rest, _), parts in used.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == rest
    return sum(c * (packing.padded_to(f, size) - f) for f, c, _ in packs)


@pytest.mark.parametrize("counts", [{600: 1000}, {700: 3}, {1: 5000}, {1000: 50, 30: 7}, {513: 400, 512: 3, 511: 100}, {k: 1 + k % 7 for k in range(1, 1024)}, {}])
def test_histogram(counts):
    packs = packing.packed_histogram(counts)
    waste = slots_cover(packs, counts, 1024)
    assert waste <= 0.01 * sum(k * n for k, n in counts.items()) + 2048
    layers = packing._layers(packs, 1024)
    found = defaultdict(int)
    for x in layers:
        assert (np.diff(x["key"]) > 0).all() and (x["key"][1:] >= x["key"][:-1] + x["count"][:-1]).all()
        for key, n, length in zip(x["key"].tolist(), x["count"].tolist(), x["length"].tolist(), strict=True):
            found[key >> 40] += n * length
    assert dict(found) == {k: k * n for k, n in counts.items()}


def test_shortest_pack_first():
    """Against one piece at a time: each to the shortest pack that is open, else to a new one."""
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(12)}
        fills = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                low = min(range(len(fills)), key=fills.__getitem__, default=None)
                if low is None or fills[low] + length > 64:
                    fills.append(length)
                else:
                    fills[low] += length
        got = [f for f, c, _ in packing.packed_histogram(counts, 64, padding=1.0) for _ in range(c)]
        assert sorted(got) == sorted(fills)


def test_repeated_null_and_clashing(spark, documents, plain):
    rows = [(None, "a b"), (None, "a b"), (3, None), (3, None)]
    df = documents(rows).selectExpr("*", "1 as ids", "2 as rank", "'x' as part")
    got = packing.packed(df).collect()
    assert sorted((p.doc_id is None, p.length) for p in got) == [(False, 1), (False, 1), (True, 3), (True, 3)]
    assert packing.packed(documents([])).count() == 0


def test_sequences_and_digests(spark, sf, plain):
    got = packing.op13_packed_sequences(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    ids = {k: np.array(plain(t), "<u4") for k, t in texts.items()}
    assert sum(p.length for p in got) == sum(map(len, ids.values()))
    for p in got:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    pieces = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"))
    whole = packing.sequences(pieces)
    assert whole.selectExpr("sum(length(ids))").first()[0] == 4 * sum(map(len, ids.values()))
    share = packing.padding_share(pieces).first()
    assert share.padding <= 0.01 * share.ids + 1024
