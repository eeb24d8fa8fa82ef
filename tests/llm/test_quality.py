import random

import numpy as np
import pytest

from tessera.llm import quality

WORDS = [f"{a}{b}" for a in ("ta", "mo", "ri", "ke", "su") for b in ("lo", "ven", "dar", "mi", "an", "est")]


def text(rng, kind):
    w = [rng.choice(WORDS) for _ in range(rng.randrange(40, 200))]
    if kind == "shout":
        return " ".join(x.upper() + "!!" for x in w)
    if kind == "loop":
        return " ".join([w[0]] * len(w))
    if kind == "rude":
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(["blast", "dolt"])
    return " ".join(w) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        kind = rng.choice(["fine"] * 6 + ["shout", "loop", "rude"])
        docs.append((i, text(rng, kind), "en", f"s{rng.randrange(5)}"))
        if i % 2:
            labels.append((i, int(kind in ("fine", "rude")), int(kind == "rude")))
    kinds = {i: t for i, t, *_ in docs}
    return docs, labels, kinds


def bad(t):
    return "!!" in t or "blast" in t or "dolt" in t or len(set(t.split())) == 1


def test_unlabelled_documents(spark, documents, corpus):
    docs, labels, kinds = corpus
    extra = [(2000, None), (2001, ""), (2002, "tal " * 100_000), (None, docs[0][1]), (3, docs[3][1])]
    out = quality.rated(documents([*docs, *extra]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + len(extra)
    seen = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0}
    clean = [r.keep for i, r in seen.items() if not bad(kinds[i])]
    junk = [r.keep for i, r in seen.items() if bad(kinds[i])]
    assert np.mean(clean) > 0.97
    assert np.mean(junk) < 0.05
    assert all(0 <= p <= 1 for r in out for p in (r.text_prob, r.meta_prob, r.score))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_too_few_labels(spark, documents, labels):
    out = quality.rated(documents([(1, "a"), (2, "b")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert [(r.score, r.keep) for r in out] == [(0.5, True)] * 2


def test_empty_table(spark, documents):
    assert quality.rated(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_each_view_learns_from_the_other():
    """The weak view gains from what the strong one labels."""
    rng = np.random.default_rng(0)
    n = 4000
    y = rng.integers(0, 2, n)
    strong = y[:, None] * 4.0 + rng.normal(size=(n, 3))
    weak = y[:, None] * 0.8 + rng.normal(size=(n, 8))
    known, held = np.arange(n) < 40, np.arange(n) % 4 == 1
    label = np.where(known, y, -1)
    label[40:140] = y[40:140]
    held[40:140], held[:40] = True, False
    with_, without = (quality.co_trained(strong, weak, label, held, rounds) for rounds in (3, 0))
    test = slice(2000, n)
    acc = [((quality.log_odds(m["models"]["meta"], weak[test]) > 0) == y[test]).mean() for m in (with_, without)]
    assert acc[0] > acc[1] + 0.01
    p = quality.scored(with_, strong[test], weak[test])[2]
    assert ((p > 0.5) == y[test]).mean() > 0.95


def test_calibration_is_honest():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * raw + 1)))).astype(float)
    a, b = quality.calibrated(raw, y)
    assert abs(a - 0.5) < 0.05
    assert abs(b - 1) < 0.1


def test_repeated_labels_nulls_and_clashing_columns(spark):
    """A document labelled twice counts once, as the worse; null source, lang, length and text have scores; extra columns do not matter."""
    from pyspark.sql import functions as F

    rows = [(i, f"good plain words number {i} about the garden and the sea" if i % 2 else "spam ! buy | now % " * 5, None if i % 5 == 0 else "en", None if i % 7 == 0 else "a", None if i % 3 == 0 else 40) for i in range(200)]
    rows += [(500, None, None, None, None), (None, "no id here", "en", "a", 3), (7, rows[7][1], "en", "a", 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(7, 0, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    plain = sorted((tuple(r) for r in quality.rated(docs, labels).collect()), key=repr)
    clash = docs.withColumns({c: F.lit("x") for c in ("good", "score", "keep", "views", "meta", "bucket")})
    assert sorted((tuple(r) for r in quality.rated(clash, labels).collect()), key=repr) == plain
    assert len(plain) == len(rows)
    assert all(0 <= p <= 1 for r in plain for p in r[1:4])
    once = labels.where("not (doc_id = 7 and quality = 1)")
    assert sorted((tuple(r) for r in quality.rated(docs, once).collect()), key=repr) == plain


def test_telling_ngrams_equal_a_brute_force(spark, documents, monkeypatch):
    """The counted and chosen n-grams are those of a plain count of words and pairs, bucket by bucket; a telling pair of plain words is among them."""
    monkeypatch.setattr(quality, "NGRAMS", 8)
    rng = random.Random(4)
    docs, known = [], []
    for i in range(300):
        w = [rng.choice(WORDS) for _ in range(30)]
        good = rng.random() < 0.7
        at = rng.randrange(len(w))
        w[at:at] = ["green", "moon"] if not good else ["moon", "green"]
        docs.append((i, " ".join(w)))
        known.append((i, int(good)))
    got = quality.telling_ngrams(documents(docs), spark.createDataFrame(known, "doc_id long, good int"))
    hasher, seen = quality._plain_words(), {}
    for (_, t), (_, good) in zip(docs, known, strict=True):
        for b in set(quality._bucketed(hasher.of_texts([t.encode()])[0]).tolist()):
            seen.setdefault(b, [0, 0])[good] += 1
    bad, fine = sum(g == 0 for _, g in known), sum(g for _, g in known)
    chi, lift = {}, {}
    for b, (x, y) in seen.items():
        if x + y >= 5:
            share = (x + y) / len(docs)
            c = (x - bad * share) ** 2 / max(1e-9, share * (1 - share) * bad * fine / len(docs))
            if c < quality.LEAST_CHI:
                continue
            chi[b] = c
            if x >= max(5, 0.005 * bad):
                lift[b] = x / bad / ((y + 1) / fine)
    best = sorted(chi, key=lambda b: (-round(chi[b], 9), b))[:4]
    rest = sorted((b for b in lift if b not in best), key=lambda b: (-round(lift[b], 9), b))[:4]
    assert got.tolist() == sorted(best + rest)
    words, _ = hasher.of_texts([b"green moon"])
    pair = quality._bucketed(words)[-1]
    assert pair >= quality.BUCKETS
    assert pair in got


def test_all_unlabelled_rows_take_part(spark, documents, corpus, monkeypatch):
    """The model from Spark's sums over the feature table is that of plain arrays of the same rows, whatever the partitions; every unlabelled row counts."""
    docs, labels, _ = corpus
    frame = documents([*docs, (None, docs[0][1]), (4, docs[4][1])]).repartition(7)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cols = ("doc_id", "text", "source", "lang", "n_chars")
    model, features = quality.learn(quality._columns(frame, *cols), known)
    rows = features.collect()
    assert sum(r.good == -1 for r in rows) == 452
    assert len(rows) == 902
    text, meta = quality._unpacked([r.numbers for r in rows], [r.bits for r in rows], len(model["told"]))
    y = np.array([r.good for r in rows])
    held = np.array([r.doc_id is not None and quality.zlib.crc32(str(r.doc_id).encode()) % 4 == 1 for r in rows])
    plain = quality.co_trained(text, meta, y, held)
    without = quality.co_trained(text[y >= 0], meta[y >= 0], y[y >= 0], held[y >= 0])
    for v in ("text", "meta"):
        np.testing.assert_allclose(model["models"][v]["b"], plain["models"][v]["b"], atol=1e-6)
    gained = plain["models"]["meta"]["b"] - without["models"]["meta"]["b"]  # the text view is sure about many rows, the metadata view about none
    assert np.abs(gained).max() > 1e-3

    monkeypatch.setattr(quality, "LABELLED", 300)  # labelled documents beyond the bound are no unlabelled ones
    _, features = quality.learn(quality._columns(frame, *cols), known)
    assert {r.good: r["count"] for r in features.groupBy("good").count().collect() if r.good in (-1, 2)} == {-1: 452, 2: 150}


def test_packed_features_come_back():
    hasher, classes = quality._plain_words(), quality._byte_classes()
    texts = [b"", b"one two two", "été ".encode() * 50]
    told = np.sort(quality._bucketed(hasher.of_texts([texts[1]])[0]))
    batch = quality.pa.table({"source": ["a", None, "b"], "lang": ["en", None, None], "n_chars": [0, None, 200]})
    want = quality._features(batch, texts, hasher, classes, told)
    got = quality._unpacked(*(c.to_pylist() for c in quality._packed(*want)), len(told))
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-6)
