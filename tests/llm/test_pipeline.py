"""The stages on the given tables, each against a plain version of its decision."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_neardup import brute_force


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input of each stage, and the last result."""
    base = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, docs[-1], sf).write.parquet(str(base / name))
        docs.append(spark.read.parquet(str(base / name)))
    return [{"df": d, "rows": d.collect()} for d in docs]


def test_stage_names_and_columns(stages):
    assert len(P.STAGES) == 5
    for s in stages[:-1]:
        assert s["df"].columns == P.COLUMNS


def test_language_keeps_all_texts_with_letters(stages):
    want = {r.doc_id for r in stages[0]["rows"] if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in stages[1]["rows"]} == want
    lang = {r.doc_id: r.lang for r in stages[0]["rows"]}
    assert sum(lang[r.doc_id] == r.lang for r in stages[1]["rows"]) > 0.97 * len(stages[1]["rows"])


def test_one_of_each_near_duplicate_group_stays(stages):
    rows = sorted(stages[1]["rows"], key=lambda r: r.doc_id)
    want = {rows[d].doc_id for d, (_, c) in brute_force([r.text for r in rows], P.SIMILAR).items() if c == d}
    assert {r.doc_id for r in stages[2]["rows"]} == want


def test_contaminated_documents_go(spark, sf, stages):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2]["rows"] if not any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in stages[3]["rows"]} == want


def shares(size):
    """Each source's target: all words by weights 1, 2, 3 in code point order (null last), at most three times a source's own, the excess shared again."""
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(names)}
    left, goal = sum(size.values()), {}
    while True:
        free = [x for x in names if x not in goal]
        over = [x for x in free if left * weight[x] > 3 * size[x] * sum(weight[y] for y in free)]
        if not over:
            return {**goal, **{x: left * weight[x] / sum(weight[y] for y in free) for x in free}}
        for x in over:
            goal[x] = 3 * size[x]
        left = sum(size.values()) - sum(goal.values())


def test_mix_follows_weights(stages):
    """Each source's words are near its own target: a document's share is rounded to whole times."""
    before, after = ({(r.doc_id): r for r in stages[k]["rows"]} for k in (3, 4))
    assert set(after) <= set(before)
    assert max(Counter(r.doc_id for r in stages[4]["rows"]).values()) <= 3
    size, got, longest = Counter(), Counter(), Counter()
    for r in stages[3]["rows"]:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        size[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in stages[4]["rows"]:
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    goal = shares(size)
    assert max(goal[s] / size[s] for s in size) > 1.3 * min(goal[s] / size[s] for s in size)  # a mix without weights would fail below
    for s in size:
        assert abs(got[s] - goal[s]) <= 0.02 * goal[s] + longest[s], (s, got[s], goal[s])


@pytest.mark.parametrize("stage", ["mix_sources", "shard"])
def test_many_copies_without_an_id(spark, sf, stage):
    """Ten thousand rows of one text and no id, under two languages, beside other rows: each has a decision of its own."""
    text = "a text without an id that is repeated very often"
    rows = [(None, text, "en" if k % 3 else "de", "a", len(text)) for k in range(10_000)] + [(k, f"w{k} " * 40, "en", "ab"[k % 2], 200) for k in range(300)]
    rows += [(7_000, None, "en", "a", None), (7_000, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(P.STAGES)[stage](spark, docs, sf).collect()
    count = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out)
    if stage == "shard":
        assert count == Counter(rows)
        assert len({(r["shard"], r.slot) for r in out}) == len(out)
    else:
        keyed = P._named(docs)
        mixed = P.mixing.mix(keyed.select("row_key", "text", "source"), id_col="row_key").where("size > 0").collect()
        want = Counter()
        for r in mixed:
            want[r.doc_id] += int(r.taken / r["size"] + 0.5)
        got = Counter(r.row_key for r in P._named(spark.createDataFrame(out, docs.schema)).collect())
        assert got == +want
        assert set(count) <= set(rows)


def test_shards_hold_every_row_once(stages):
    assert Counter((r.doc_id, r.text) for r in stages[5]["rows"]) == Counter((r.doc_id, r.text) for r in stages[4]["rows"])
    slots = {}
    for r in stages[5]["rows"]:
        slots.setdefault(r["shard"], []).append(r.slot)
        assert r["size"] == len(r.text.encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_equals_the_stages(spark, sf, stages):
    got = P.run(spark, sf)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in stages[5]["rows"])


ODD = [
    (1, "some words of a text that is long enough to have shingles", "en", "a", 10), (1, "some words of a text that is long enough to have shingles", "en", "a", 10),
    (1, "another text under the same id with several words in it", None, None, None), (None, "a text that has no id but has words", "en", None, 3),
    (None, "a text that has no id but has words", "en", None, 3), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, "123 !!", "de", "b", 6),
    (5, "word " * 50_000, "de", "b", 250_000), (6, "short", "en", "b", 5), (7, "short", "en", "b", 5),
]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_documents_pass_every_stage(spark, sf, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "kept", "items", "score", "row_key", "shard"):
        docs = docs.selectExpr("*", f"'clash' as {c}")
    counts = []
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    if rows:
        long = rows[8][1]
        assert counts[0] == Counter((r[0], r[1]) for r in rows if r[0] not in (2, 3, 4))
        assert set(counts[0]) - set(counts[1]) == {(7, "short")}
        assert counts[2] == counts[1]
        assert all(k in counts[2] and n <= 3 * counts[2][k] for k, n in counts[3].items())
        assert (5, long) in counts[3]
        assert counts[4] == counts[3]


def test_equal_rows_of_two_sources_keep_their_own_decisions(spark, sf):
    """One id and text under a small source, which is taken several times, and a large one, which is taken once or not at all."""
    rows = [(1, "ten words " * 5, "en", "a", 50), (1, "ten words " * 5, "en", "b", 50)] + [(i, f"word{i} " * 30, "en", "b", 180) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.source: round(r.taken / r["size"]) for r in P.mixing.mix(docs.selectExpr("source as doc_id", "source", "text", "doc_id as d").where("d = 1").union(docs.selectExpr("'rest'", "source", "text", "doc_id").where("doc_id > 1"))).where("doc_id in ('a', 'b')").selectExpr("doc_id as source", "size", "taken").collect()}
    got = Counter(r.source for r in P.mix_sources(spark, docs, sf).collect() if r.doc_id == 1)
    assert got["a"] == want["a"] == 3
    assert got["b"] <= 3


def test_rows_of_equal_id_and_text_stay_once(spark, sf):
    text = "several words that make a text of some length for all"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "b", 2), (2, text, "en", "a", 1), (3, "another text of quite different words than those above", "en", "a", 1), (3, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.source, r.text is None) for r in P.near_dedup(spark, docs, sf).collect()) == [(1, "a", False), (3, "a", False), (3, "a", True)]
