import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as D

COMMON = "the of and to in is it that was for on are as with his they at be this from".split()


def words(text):
    out, w = [], ""
    for c in (text or "").lower() if (text or "").isascii() else "".join(x.lower() if x.isascii() else x for x in text or ""):
        if c.isascii() and not c.isalnum():
            out, w = out + [w] * bool(w), ""
        else:
            w += c
    return out + [w] * bool(w)


def brute_force(docs, items):
    return whole_brute_force(docs, [(i, t, None) for i, t in items])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)

    def prose(n):
        return [rng.choice(COMMON) if rng.random() < 0.5 else f"w{rng.randrange(3000)}" for _ in range(n)]

    items = [(i, " ".join(prose(rng.randrange(8, 60))) + ".") for i in range(60)]
    items += [(100, " ".join(prose(400))), (101, None), (102, "!?"), (103, "rare unheard words"), (104, items[3][1]), (105, "ÄÖ ß größe, maß; straße höhe ende")]
    docs = [(d, " ".join(prose(rng.randrange(1, 500)))) for d in range(120)]
    text = dict(items)
    for d in range(120, 200):
        item = text[rng.choice([i for i, t in items if t and len(t) > 20])].split()
        if rng.random() < 0.4:
            item[rng.randrange(len(item))] = "changed"
        if rng.random() < 0.2:
            item = item[: len(item) // 2]
        body = prose(rng.randrange(0, 300))
        at = rng.randrange(len(body) + 1)
        docs.append((d, "\n".join([" ".join(body[:at]), " ".join(item).upper() if rng.random() < 0.2 else " ".join(item), " ".join(body[at:])])))
    docs += [(300, None), (301, ""), (302, "say: rare, unheard WORDS"), (303, "rare unheard words"), (304, " ".join(prose(30_000)) + " " + text[5]), (305, text[7] + " " + text[8])]
    return docs, items


def run(spark, documents, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r.items_found for r in D.matched(documents(docs), bench, **more).select("doc_id", F.col("items").alias("items_found")).collect()}


def test_brute_force(spark, documents, corpus):
    docs, items = corpus
    assert run(spark, documents, docs, items) == brute_force(docs, items)


def test_short_items_and_parts_are_found(spark, documents, corpus):
    """Those whose parts have one to four words, in longer documents."""
    docs, items = corpus
    found = run(spark, documents, docs, items)
    assert found[302] == found[303] == [103]
    few = [i for i, t in items if 5 <= len(words(t)) < 15]
    assert any(set(few) & set(v) for v in found.values())


def test_slices_of_a_large_benchmark(spark, documents, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(D, "SLICE", 20)
    assert run(spark, documents, docs[100:], items) == brute_force(docs[100:], items)


def test_many_slices_are_one_stage(spark, documents, monkeypatch):
    """A hundred slices in one Python node; a text hashed once; items of all slices found, also twice in one document."""
    monkeypatch.setattr(D, "SLICE", 3)
    monkeypatch.setattr(D, "SWEEP", 20_000)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(300)]
    docs = [(d, f"before {items[d][1]} between {items[(d * 7) % 300][1]} after") for d in range(300)] + [(400, None), (401, "clean text of some words"), (402, items[5][1] + " x" * 50_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.matched(documents(docs), bench)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: (r["items"], r["overlap"]) for r in out.collect()}
    assert got == {**{d: (sorted({d, (d * 7) % 300}), 1.0) for d in range(300)}, 400: ([], 0.0), 401: ([], 0.0), 402: ([5], 1.0)}


def test_bounds_hide_nothing(corpus):
    """Block bounds give the same items as scoring all postings."""
    import numpy as np

    docs, items = corpus
    index = D.build_index([(i, t, None) for i, t in items])
    words_, bounds = D._hasher().of_texts([(t or "").encode() for _, t in docs[110:160]])
    with_bounds = D.candidates(index, words_, bounds)
    for bound in ("bound", "rows", "most"):
        index[bound] = np.full_like(index[bound], 1.0)
    assert with_bounds == D.candidates(index, words_, bounds)
    assert sum(map(len, with_bounds)) > 20


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_wand_equals_scoring_everything(corpus, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(D, "BLOCK", block)
    docs, items = corpus
    index = D.build_index([(i, t, None) for i, t in items])
    matrix = np.zeros((len(index["vocabulary"]), index["n"]))
    term = np.repeat(np.arange(len(index["vocabulary"])), np.diff(index["posting_at"]))
    matrix[term, index["posting_doc"]] = index["posting_weight"]
    hasher, found = D._hasher(), 0
    for _, text in docs[100:200]:
        words_, _ = hasher.of_texts([text.encode()])
        terms = np.flatnonzero(np.isin(index["vocabulary"], words_[:128]))
        for threshold in (0.2, 0.5):
            want = np.flatnonzero(matrix[terms].sum(0) >= threshold - 1e-6).tolist()
            assert D.wand(index, terms, np.ones(index["blocks"], bool), threshold) == want
            found += len(want)
    assert found > 20


def test_scores_do_not_depend_on_slices(spark, corpus):
    """An index of a slice has the weights that the whole index has."""
    import pickle

    _, items = corpus
    bench = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, answer string")

    def weights(slices):
        out = {}
        for r in D.indexes(bench.withColumn("slice", (F.col("item_id") % slices).cast("int")), slices).collect():
            x = pickle.loads(r["index"])
            term = x["posting_key"] // x["n"]
            for t, d, w in zip(term, x["posting_doc"], x["posting_weight"], strict=True):
                out.setdefault((int(x["ids"][x["chunk_of"][d]]), int(x["vocabulary"][t])), []).append(float(w))
        return {k: sorted(v) for k, v in out.items()}

    whole = weights(1)
    for other in (weights(3), weights(5)):
        assert other.keys() == whole.keys()
        assert all(other[k] == pytest.approx(whole[k], rel=1e-5) for k in whole)


def test_question_and_answer_far_apart(spark, documents):
    filler = " ".join(f"f{i % 50}" for i in range(400))
    bench = spark.createDataFrame([(1, "which old town has the tall tower", "the one by the green needle over there")], "item_id long, text string, reply string")
    got = D.matched(documents([f"the one by the green needle over there {filler} which old town has the tall tower"]), bench, answer_col="reply")
    assert [r["items"] for r in got.collect()] == [[1]]


def test_answers_in_a_column(spark, documents):
    bench = spark.createDataFrame([(1, "what is the tall tower in that old town", "it is called the green needle by everyone there")], "item_id long, text string, reply string")
    both = "what is the tall tower in that old town it is called the green needle by everyone there"
    got = D.matched(documents(["so " + both, "what is the tall tower in that old town"]), bench, answer_col="reply")
    assert [r.n_items for r in got.orderBy("doc_id").collect()] == [1, 0]
    item = spark.createDataFrame([(1, both)], "item_id long, text string")
    assert [r.contaminated for r in D.matched(documents(["so " + both, "what is the tall tower in that old town"]), item).orderBy("doc_id").collect()] == [True, False]


def test_empty_tables_and_clashing_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.matched(documents(["a b"]), none).collect()] == [False]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.matched(documents([]), some).count() == 0
    docs = documents(["a b", None]).withColumns({"items": F.lit("x"), "overlap": F.lit(1), "n_items": F.lit(2)})
    assert [r.n_items for r in D.matched(docs, some).orderBy("doc_id").collect()] == [1, 0]


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def whole_brute_force(docs, items):
    """items: (id, question, answer or None). A part of fewer than five words is a run of its own length."""
    found, items = {}, [(i, words(question), words(answer), answer) for i, question, answer in items]
    for d, t in docs:
        have, mine = words(t), []
        own = {n: runs(have, n) for n in range(1, 6)}
        for i, q, a, answer in items:
            if not answer:
                cut = len(q) - len(q) // 3
                parts, whole = [q[:cut], q[cut:]], runs(q, min(5, len(q)))
            else:
                parts, whole = [q, a], runs(q, min(5, len(q))) | runs(a, min(5, len(a)))
            if not q:
                continue
            shares = [len(r & own[min(5, len(p))]) / len(r) for p in parts if p for r in [runs(p, min(5, len(p)))]]
            in_doc = sum(r in own[len(r)] for r in whole) / len(whole)
            if in_doc >= 0.8 and min(shares) >= 0.5:
                mine.append(i)
        found[d] = sorted(mine)
    return found


def test_items_of_few_words_and_short_answers(spark, documents, tmp_path):
    rng = random.Random(9)
    item = {n: " ".join(f"n{n}k{k}" for k in range(n)) for n in (1, 3, 8, 14)}
    filler = lambda n: " ".join(f"f{rng.randrange(50)}" for _ in range(n))
    docs = [(n, f"{filler(20)}\n{t.upper()}, {filler(20)}") for n, t in item.items()] + [(20, filler(60)), (21, "n3k0 n3k2 n3k1 " + filler(9)), (22, item[8].rsplit(" ", 2)[0] + " " + filler(9)), (23, item[3])]
    plain = [(n, t, None) for n, t in item.items()]
    want = whole_brute_force(docs, plain)
    assert [want[n] for n in item] == [[n] for n in item]
    assert run(spark, documents, docs, [(i, t) for i, t, _ in plain]) == want

    asked = "what is the tall tower in that old town called by all"
    bench = [(1, asked, "needle"), (2, "who wrote it", "an old hand"), (3, asked, "spire")]
    docs = [(1, f"{asked} {filler(9)} needle {filler(9)}"), (2, f"{filler(9)} who wrote it? {filler(4)} An old hand. {filler(5)}"), (3, f"{asked} {filler(20)}")]
    frame = spark.createDataFrame(bench, "item_id long, text string, reply string")
    got = {r["doc_id"]: r["items"] for r in D.matched(documents(docs), frame, answer_col="reply").collect()}
    assert got == whole_brute_force(docs, bench) == {1: [1], 2: [2], 3: []}

    import corpus_pipeline as P

    spark.createDataFrame([(i, t) for i, t, _ in plain], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents([(5, f"{filler(30)} {item[8]} {filler(30)}"), (6, filler(30))]).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["items"] for r in D.op6_decontaminate(spark, str(tmp_path)).collect()} == {5: [8], 6: []}
    assert [r.doc_id for r in P.decontaminate(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()] == [6]
