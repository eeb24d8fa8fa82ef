import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    k = line.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    return k if len(k) >= 10 else None


def brute_force(docs):
    """{doc: (lines, dropped, kept text)}"""
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) and len(holders[key(x)]) > 1 and min(holders[key(x)]) != d)]
        out[d] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    pool = [f"shared line number {i}" for i in range(30)] + ["short", "  PADDED shared line \t", "padded SHARED line", "exactly10c", "nine chars", "ÄÖÜäöüßéèê", "äöüÄÖÜßéèê"]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {d} {i}" for i in range(rng.randrange(1, 12)))) for d in range(60)]
    return [*docs, (60, None), (61, ""), (62, "\n\n"), (63, "shared line number 1\n" * 5 + "end of it all"), (64, "a very long line " * 40_000)]


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def test_brute_force(spark, documents, corpus):
    assert result(lines.deduplicated(documents(corpus), shards=4)) == brute_force(corpus)


def test_insert_and_delete_equal_a_new_build(spark, documents, corpus):
    first, later = corpus[:30], corpus[30:]
    index = lines.inserted(lines.built(documents(first), 4), documents(later), 4)
    assert result(lines.without_repeats(documents(corpus), index)) == brute_force(corpus)
    gone = {d for d, _ in corpus if d % 3 == 0}
    index = lines.deleted(index, spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    rest = [(d, t) for d, t in corpus if d not in gone]
    assert result(lines.without_repeats(documents(rest), index)) == brute_force(rest)
    built = lines.built(documents(rest), 4)
    assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, built.counts.collect()))


def test_null_ids_and_repeated_rows(spark, documents):
    same = "a line that is long enough"
    got = [(r.doc_id, r.n_dropped) for r in lines.deduplicated(documents([(None, same), (5, same), (5, same)])).collect()]
    assert sorted(got, key=repr) == [(5, 0), (5, 0), (None, 0)]


def test_empty_table(spark, documents):
    assert lines.deduplicated(documents([])).count() == 0


def test_query_hashes_the_kept_text(spark, documents, corpus, tmp_path):
    documents(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, (_, _, t) in brute_force(corpus).items()}
    assert {r.doc_id: r.kept_sha256 for r in lines.op5_line_dedup(spark, str(tmp_path)).collect()} == want


def test_shards_grow_with_the_keys(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    first, later = corpus[:10], corpus[10:]
    index = lines.built(documents(first), 1)
    assert index.shards > 1
    more = lines.inserted(index, documents(later))
    assert more.shards > index.shards
    assert more.counts.where(F.col("shard") >= more.shards).count() == 0
    assert more.filters.count() > index.filters.count()
    assert result(lines.without_repeats(documents(corpus), more)) == brute_force(corpus)
    gone = {d for d, _ in corpus if d % 4 == 0}
    less = lines.deleted(more, spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    rest = [(d, t) for d, t in corpus if d not in gone]
    assert result(lines.without_repeats(documents(rest), less)) == brute_force(rest)
    with pytest.raises(ValueError, match="shards"):
        lines.inserted(more, documents(later), more.shards + 1)


@pytest.mark.parametrize("asked", [10, 1 << 20])
def test_filters_too_large_to_broadcast(spark, documents, corpus, monkeypatch, asked):
    monkeypatch.setattr(lines, "FILTER_BLOCK", 1)
    monkeypatch.setattr(lines, "ASKED", asked)
    docs = documents(corpus)
    assert result(lines.deduplicated(docs, shards=4)) == brute_force(corpus)
    hot = documents([(d, f"the same line in each of them\nown line of number {d}") for d in range(200)])
    dropped = {r.doc_id: r.n_dropped for r in lines.deduplicated(hot, shards=4).collect()}
    assert dropped == {d: int(d > 0) for d in range(200)}


def test_filter_blocks(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(lines, "FILTER_BLOCK", 1)
    docs = documents(corpus)
    index = lines.built(docs, 4)
    assert result(lines.without_repeats(docs, index)) == brute_force(corpus)
    assert lines.possible_repeats(index.refs, index.filters.where(F.lit(False))).count() == 0


def test_cuckoo():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**62), 2**62, (2, 20_000))
    c = lines.Cuckoo.for_keys(20_000)
    assert c.insert(k[0], k[1])
    assert c.holds(k[0], k[1]).all()
    other = rng.integers(-(2**62), 2**62, (2, 20_000))
    assert c.holds(other[0], other[1]).mean() < 0.001
    c = lines.Cuckoo.from_bytes(c.to_bytes())
    c.delete(k[0][:5000], k[1][:5000])
    assert c.holds(k[0][5000:], k[1][5000:]).all()
    assert c.holds(k[0][:5000], k[1][:5000]).mean() < 0.01
    assert not lines.Cuckoo.for_keys(10).insert(k[0][:200], k[1][:200])


def test_clashing_columns(spark, documents, corpus):
    docs = documents(corpus).withColumns({c: F.lit("x") for c in ("shard", "k1", "k2", "lose", "first_doc", "n_lines", "filter")})
    assert result(lines.deduplicated(docs, shards=4)) == brute_force(corpus)
