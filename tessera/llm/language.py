"""Language ID by cross-parsing entropy.

Per language, a suffix automaton of a sample of labelled text accepts exactly the strings that occur in the sample. A document is
parsed into the longest phrases that occur there, one after the other; few phrases mean text of that language. The number
of phrases times the logarithm of the sample's length, per symbol, estimates the cross entropy; the smallest wins.

Symbols are lower-cased letters. Each language numbers all letters of its own sample; any other letter starts a phrase there and matches
nothing. A run of anything else is one gap. A document is parsed whole, in windows of WINDOW symbols that each start a new phrase; all windows of a batch of documents go
through an automaton together, one symbol at a time, as array operations on its transition table.

Scale: the fit takes PIECES pieces of PIECE characters for each language, from documents chosen by a hash of doc_id (a documented,
bounded sample), for every label. The tables are broadcast: a few MB a language where letters are few (DENSE), else a sorted list of
the automaton's transitions, at most 3 * PIECES * PIECE of 12 bytes each. Both give the same parse. Prediction is one pass over the texts without a shuffle.

Edge cases: a null text or one without a letter is `und` with score 0, as is every text when nothing was learned; with a single language
every score of a text with letters is 1. Ties go to the first language in code point order. Very long texts are parsed whole. Repeated
rows each get a prediction; a null doc_id is not held out and never learned from. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table, with_columns, written

FOLDS = 5
PIECES, PIECE = 64, 320
#: Most symbols of a language, and languages, with a full table of states by symbols; beyond that its transitions are searched.
DENSE, DENSE_LANGUAGES = 128, 64
WINDOW = 512
_POINTS = 0x110000
UNSEEN, GAP = 0, 1


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def samples(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> dict[str, list[str]]:
    """Pieces of training text by language: from the documents with letters that have the smallest hashes, at a place that the hash decides."""
    h = F.xxhash64("doc_id")
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = learn.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= pieces).select("doc_id", "lang").distinct()
    start = F.pmod(h, F.greatest(F.lit(1), F.length("text") - piece)).cast("int") + 1
    cut = docs.join(small(written(chosen, "chosen")), ["doc_id", "lang"]).select("lang", "doc_id", F.substr("text", start, F.lit(piece)).alias("t"))
    rows = cut.groupBy("lang", "doc_id").agg(F.min("t").alias("t")).orderBy("lang", "doc_id").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        if r["t"]:
            out.setdefault(r["lang"], []).append(r["t"])
    return out


def alphabet(texts: dict[str, list[str]]) -> dict[str, int]:
    """All letters of all samples, the commonest first, numbered from 2."""
    found = pd.Series([c for pieces in texts.values() for t in pieces for c in t.lower() if c.isalpha()], dtype="object").value_counts()
    return {c: i + 2 for i, c in enumerate(sorted(found.index, key=lambda c: (-found[c], c)))}


def symbol_table(letters: dict[str, int]) -> np.ndarray:
    """The symbol of each code point."""
    kind = np.uint8 if len(letters) < 250 else np.int32
    out = np.array([UNSEEN if chr(c).isalpha() else GAP for c in range(_POINTS)], kind)
    for c, i in letters.items():
        for x in {c, c.upper()}:
            if len(x) == 1:
                out[ord(x)] = i
    return out


def symbols_of(text: str, of_point: np.ndarray) -> np.ndarray:
    s = of_point[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    gap = s == GAP
    return s[~gap | ~np.concatenate(([False], gap[:-1]))] if len(s) else s


def automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def parse_table(s: np.ndarray, width: int) -> np.ndarray:
    """For each state and symbol: twice the offset of the next state's row, plus 1 where a phrase starts.

    A missing transition starts a phrase at its symbol. The last row is the state before any phrase, where every symbol starts one;
    the last symbol is padding, which changes nothing."""
    nxt = automaton(s.tolist())
    none = len(nxt)
    start = np.full(width, none, np.int64)
    start[list(nxt[0])] = list(nxt[0].values())
    out = np.tile(2 * width * start + 1, (none + 1, 1))
    for i, to in enumerate(nxt):
        if to:
            out[i, list(to)] = 2 * width * np.array(list(to.values()))
    out[:, width - 1] = 2 * width * np.arange(none + 1)
    return out.reshape(-1).astype(np.int32)


def parse_list(s: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The same automaton as sorted transitions: `keys` (state * width + symbol), `to`, and by symbol the state that a phrase starts in."""
    nxt = automaton(s.tolist())
    start = np.full(width, len(nxt), np.int32)
    start[list(nxt[0])] = list(nxt[0].values())
    keys = np.array([i * width + c for i, to in enumerate(nxt) for c in to], np.int64)
    to = np.array([t for to in nxt for t in to.values()], np.int32)
    order = np.argsort(keys)
    return {"keys": keys[order], "to": to[order], "start": start, "none": np.int64(len(nxt))}


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The fitted model: languages, symbols by code point, and a parse table and bits a phrase for each language."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = samples(docs)
    letters = alphabet(texts)
    of_point = symbol_table(letters)
    odd = sorted({c for pieces in texts.values() for t in pieces for c in t if c.isalpha() and of_point[ord(c)] == UNSEEN})  # letters that no lower case names
    if odd:
        of_point = of_point.astype(np.int32)
        of_point[[ord(c) for c in odd]] = np.arange(len(odd)) + len(letters) + 2
    width = len(letters) + len(odd) + 3
    langs, tables, own, bits = [], [], [], []
    for lang in sorted(texts):
        s = symbols_of("\n".join(texts[lang]), of_point)
        if (s != GAP).any():
            have = np.unique(s[s > GAP])
            mine = np.zeros(width, np.int32)  # a letter that this sample has not is UNSEEN
            mine[GAP], mine[have], mine[width - 1] = GAP, np.arange(len(have)) + 2, len(have) + 2
            langs.append(lang)
            full = len(have) + 3 <= DENSE and len(texts) <= DENSE_LANGUAGES
            tables.append((parse_table if full else parse_list)(mine[s], len(have) + 3))
            own.append(mine)
            bits.append(float(np.log2(len(s) + 1)))
    return {"langs": langs, "of_point": of_point, "width": width, "own": own, "tables": tables, "bits": bits}


def phrase_counts(model: dict, windows: np.ndarray) -> np.ndarray:
    """Phrases of each window under each language. windows: one column for each window, padded at its end."""
    out = np.zeros((len(model["langs"]), windows.shape[1]), np.int32)
    for i, (tab, own) in enumerate(zip(model["tables"], model["own"], strict=True)):
        pad = own[-1]
        if isinstance(tab, dict):
            at = np.full(windows.shape[1], tab["none"], np.int64)
            for row in windows:
                c = own[row]
                key = at * (pad + 1) + c
                k = np.minimum(np.searchsorted(tab["keys"], key), len(tab["keys"]) - 1)
                hit = tab["keys"][k] == key
                out[i] += ~hit & (c != pad)
                at = np.where(hit, tab["to"][k], tab["start"][c]).astype(np.int64)
            continue
        at = np.full(windows.shape[1], len(tab) - (pad + 1), np.int32)
        for row in windows:
            v = tab[at + own[row]]
            out[i] += v & 1
            at = v >> 1
    return out


def predicted(texts: list[str], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, entropy in bits a symbol) of each text."""
    sym = [symbols_of(t, model["of_point"]) if t else np.zeros(0, np.uint8) for t in texts]
    letters = np.array([bool((s != GAP).any()) for s in sym], bool)
    lang, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    some = np.flatnonzero(letters)
    if not len(some) or not model["langs"]:
        return lang, score, bits
    n = np.array([len(sym[i]) for i in some])
    per = -(-n // WINDOW)
    first = np.concatenate(([0], np.cumsum(per)))
    pad = np.full(first[-1] * WINDOW, model["width"] - 1, np.int32)
    for i, at in zip(some, first[:-1] * WINDOW, strict=True):
        pad[at : at + len(sym[i])] = sym[i]
    # Windows in the order of their length: the last rows are then read for the full ones only.
    counts = np.zeros((len(model["langs"]), first[-1]), np.int64)
    grid = pad.reshape(-1, WINDOW)
    used = (grid != model["width"] - 1).sum(1)
    order = np.argsort(used, kind="stable")
    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        counts[:, part] = phrase_counts(model, np.ascontiguousarray(grid[part, : used[part].max()].T).astype(np.int32))
    total = np.add.reduceat(counts, first[:-1], axis=1) * np.array(model["bits"])[:, None] / n
    best = total.argmin(0)
    low = total.min(0)
    if len(total) > 1:
        second = np.partition(total, 1, axis=0)[1]
        score[some] = np.clip(1 - low / second, 0, 1)
    else:
        score[some] = 1.0
    bits[some] = low
    for i, b in zip(some, best, strict=True):
        lang[i] = model["langs"][b]
    return lang, score, bits


def identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits (the winner's entropy estimate for each symbol). Only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def compute(texts):
            lang, score, bits = predicted([t.decode("utf-8", "replace") for t in texts], held.value)
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(bits)]

        return compute

    return with_columns(docs, text_col, "lang_pred string, score double, bits double", make)


def op10_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
