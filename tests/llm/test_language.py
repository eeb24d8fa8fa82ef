import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language

STEMS = {"aa": "the of and to in is it that", "bb": "der die das und nicht sich auf mit", "cc": "le la les des une est dans pour", "é": "αβγ δεζ ηθι κλμ"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randrange(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choice(list(STEMS)) for _ in range(400))]
    return [*rows, (500, None, "aa"), (501, "", "aa"), (502, "123 !? ...", "bb"), (503, sentence(rng, "bb", 20_000), None), (None, sentence(rng, "cc", 30), "cc"), (504, "漢字 仮名", None)]


def plain_phrases(train, window):
    """Longest-match parsing by substring search."""
    count, at = 0, 0
    while at < len(window):
        n = 1
        while at + n < len(window) and window[at : at + n + 1] in train and window[at : at + n] in train:
            n += 1
        count, at = count + 1, at + n
    return count


def brute_force(texts, model_texts):
    """The language by parsing with plain substring search, window by window."""
    letters = language.alphabet(model_texts)
    of_point = language.symbol_table(letters)
    out = []
    for t in texts:
        s = language.symbols_of(t or "", of_point)
        if not (s != language.GAP).any():
            out.append("und")
            continue
        best = None
        for lang in sorted(model_texts):
            train = bytes(language.symbols_of("\n".join(model_texts[lang]), of_point)) if model_texts[lang] else b""
            windows = [bytes(s[i : i + language.WINDOW]) for i in range(0, len(s), language.WINDOW)]
            bits = sum(plain_phrases(train, w) for w in windows) * math.log2(len(train) + 1) / len(s)
            if best is None or bits < best[0]:
                best = (bits, lang)
        out.append(best[1])
    return out


def table(documents, corpus):
    return documents([(i, t, g, "s") for i, t, g in corpus])


def test_brute_force(spark, documents, corpus):
    docs = table(documents, corpus)
    texts = language.samples(docs)
    some = [r for r in corpus if r[0] is not None and r[0] != 503][::7] + corpus[-6:-3]
    got = {r.doc_id: r.lang_pred for r in language.identified(docs.select("doc_id", "text"), language.learn(docs)).collect()}
    assert [got[i] for i, _, _ in some] == brute_force([t for _, t, _ in some], texts)


def test_held_out_accuracy_and_contract(spark, documents, corpus, tmp_path):
    table(documents, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in language.op10_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(corpus)
    lang = {i: g for i, _, g in corpus}
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.lang_pred in {*STEMS, "und"}
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    held = [i for i, r in got.items() if r.held_out and i < 400]
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97


def test_only_text_decides(spark, documents, corpus):
    docs = table(documents, corpus)
    model = language.learn(docs)
    moved = docs.withColumns({"lang": F.lit("aa"), "source": F.lit("x"), "doc_id": F.col("doc_id") + 1000, "score": F.lit("old"), "bits": F.lit(None)})
    a = {r.text: r.lang_pred for r in language.identified(docs, model).collect()}
    b = {r.text: r.lang_pred for r in language.identified(moved, model).collect()}
    assert a == b


def test_held_out_rows_teach_nothing(spark, documents, corpus):
    docs = table(documents, corpus)
    other = docs.withColumn("text", F.when(language.held_out(F.col("doc_id")), F.lit("zzz")).otherwise(F.col("text")))
    assert language.samples(docs) == language.samples(other)


def test_nothing_learned(spark, documents):
    docs = documents([(1, "some text", None, None)])
    assert [(r.lang_pred, r.score) for r in language.identified(docs, language.learn(docs)).collect()] == [("und", 0.0)]
    assert language.identified(documents([]), language.learn(documents([]))).count() == 0


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(60)]
    nxt = language.automaton(s)
    have = {tuple(s[i:j]) for i in range(60) for j in range(i, min(60, i + 6) + 1)}

    def accepts(w):
        at = 0
        for c in w:
            if c not in nxt[at]:
                return False
            at = nxt[at][c]
        return True

    for _ in range(2000):
        w = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6)))
        assert accepts(w) == (w in have)


def many_letters(rng, first, n, rest):
    """Words of 400 letters from a code point on, each followed by one of two that are its own: the frequent ones, or only the `rest`."""
    out = []
    for _ in range(n):
        c = rng.randrange(20, 400) if rest else rng.randrange(400)
        out.append("".join(chr(first + (c * 7 + k * k) % 400) for k in range(rng.randrange(2, 5))))
    return " ".join(out)


SCRIPTS = {"ja": 0x4E00, "ko": 0xAC00, "zh": 0x6000}


@pytest.fixture(scope="module")
def scripts(documents):
    rng = random.Random(8)
    rows = [(i, many_letters(rng, SCRIPTS[g], 60, False), g) for i, g in enumerate(sorted(SCRIPTS) * 120)]
    return rows, documents([(i, t, g, "s") for i, t, g in rows])


def test_three_scripts_of_many_letters(scripts, monkeypatch):
    rows, docs = scripts
    model = language.learn(docs)
    assert sum(isinstance(t, dict) for t in model["tables"]) == 3
    rng = random.Random(3)
    asked = [(g, many_letters(rng, SCRIPTS[g], 3, True)) for g in sorted(SCRIPTS) * 40]
    lang, score, _ = language.predicted([t for _, t in asked], model)
    assert lang == [g for g, _ in asked]
    assert min(score) > 0
    assert lang == brute_force_of_letters([t for _, t in asked], language.samples(docs))
    monkeypatch.setattr(language, "DENSE", 10_000)
    full = language.learn(docs)
    assert not any(isinstance(t, dict) for t in full["tables"])
    a, b = (language.predicted([t for _, t, _ in rows[:90]] + ["plain text"], m) for m in (model, full))
    assert a[0] == b[0]
    assert np.array_equal(a[2], b[2])


def brute_force_of_letters(texts, samples):
    out = []
    for t in texts:
        sizes = {g: plain_phrases("\n".join(s).replace("\n", " "), t) * math.log2(len("\n".join(s)) + 1) for g, s in sorted(samples.items())}
        out.append(min(sizes, key=sizes.get))
    return out


def test_no_label_is_dropped(documents):
    rows = [(i, f"{chr(0x4E00 + i // 5)}{chr(0x5E00 + i // 5)} " * 5, f"l{i // 5:03d}", "s") for i in range(1500)]
    assert len(language.learn(documents(rows))["langs"]) > 290


def test_documents_without_letters_use_no_place_of_a_language(spark, documents):
    rows = [(i, None if i % 3 else "12 !", "en") for i in range(400)] + [(1000 + i, "the quick brown fox jumps over it", "en") for i in range(5)] + [(2000 + i, "zwei flinke Hasen laufen im Wald", "de") for i in range(5)]
    docs = documents(rows)
    assert language.learn(docs)["langs"] == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in language.identified(docs, language.learn(docs)).collect()}
    assert {got[1000 + i] for i in range(5)} == {"en"}
    assert {got[2000 + i] for i in range(5)} == {"de"}
    assert got[0] == "und"


def test_ties_go_to_the_first_language_and_one_language_takes_all(documents, monkeypatch):
    docs = documents([(1, "the same words in every language", "xx")])
    with monkeypatch.context() as m:
        m.setattr(language, "samples", lambda docs: {lang: ["the same words in every language"] for lang in ("xx", "aa", "mm")})
        tied = language.learn(docs)
    assert [(r.lang_pred, r.score) for r in language.identified(docs, tied).collect()] == [("aa", 0.0)]
    one = documents([(i, "words of one language", "only") for i in range(20)] + [(99, "whatever", None)])
    assert {(r.lang_pred, r.score) for r in language.identified(one, language.learn(one)).collect()} == {("only", 1.0)}
