"""Source divergence audit: how much the word shares of a language's sources differ, priced from joint tables of count levels.

A term's share in a group (language, source) depends on its count there only, so the divergence of two groups needs no term by
itself: it needs, for each pair of count levels (a, b), how many terms have count a in the one and b in the other. These joint tables come from
one-hot level products. A block of terms is an indicator matrix with one column for each (group, count level), zero included; its transpose
times itself holds the joint tables of all pairs of groups. The entries are whole numbers of at most TERMS, so the product in single
precision is exact. Each entry that is not zero is priced once and summed by pair of groups.

Shares are whole numbers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the group's occurrences of the V kept terms, and a term adds
floor((p - q)**2 / (p + q)).

Scale: tasks count words by (language, source) while they read, so what is shuffled is distinct words of a task, not words. A language's terms
are dealt to blocks by hash, TERMS to a block, and its sources to runs of GROUPS; a task of the product holds one block of terms
for one pair of runs. Sums of blocks are a row for each pair of sources. A language or source with most of the rows has more words to a
task's counter, not more rows in one task.

Edge cases: null text, language and source are read as ''. Every group that occurs has its rows of part `pair`, even without a term (value 0
if its language keeps none); a language with one source has none. Ties go by item, in UTF-8 order. Repeated rows count each. Very long texts are counted
whole, a very long term too. Other columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BLOCK, in_blocks, small, small_batches, table, written

SCALE = 1_000_000_000
#: A term is kept in a language if this many of its documents hold it.
LEAST_DOCS = 10
#: Terms of a block and sources of a run.
TERMS, GROUPS = 512, 128
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18

#: Letters lower-cased (A-Z only), bytes of other characters beyond ASCII as they are, all else blank.
_TERM_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _count(batches):
    counts: dict[tuple[str, str], dict[bytes, int]] = {}
    docs: dict[tuple[str, str], dict[bytes, int]] = {}

    def rows():
        for (lang, source), terms in counts.items():
            names, held = list(terms), docs[lang, source]
            for lo in range(0, len(names), 1 << 16):
                part = names[lo : lo + (1 << 16)]
                text = pa.array(part, pa.binary()).cast(pa.string())
                same = lambda v, n=len(part): pa.array([v], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [same(lang), same(source), text, pa.array([terms[t] for t in part], pa.int64()), pa.array([held.get(t, 0) for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    from collections import _count_elements as add  # what Counter.update() calls

    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in in_blocks([len(t) for t in texts], TEXT_BLOCK):
            for key, text in zip(zip(langs[lo:hi], sources[lo:hi], strict=True), texts[lo:hi], strict=True):
                words = text.translate(_TERM_BYTES).split()
                add(counts.setdefault(key, {}), words)
                add(docs.setdefault(key, {}), set(words))
            if sum(map(len, counts.values())) > HELD:
                yield from rows()
                counts, docs = {}, {}
    yield from rows()


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    parts = small_batches(_read(docs, text_col, lang_col, source_col)).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    parts = parts.repartition("lang", "term")  # also what kept_counts() needs: the words meet once
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The rows of term_counts() whose term is kept in its language, with total: its occurrences in the language. A window holds one term: a row a source."""
    of_term = Window.partitionBy("lang", "term")
    found = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("total", F.sum("n").over(of_term))
    return found.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total")


def group_sums(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per group (lang, source): its number g within the language (sources in UTF-8 order), n_group and n_lang (occurrences of kept terms there), v (kept terms)."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    of_lang = own.groupBy("lang").agg(F.sum("n_group").alias("n_lang")).join(terms, "lang")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source, without its terms
    return rows.select("lang", "source", nth.cast("long").alias("g"), *map(none, ("n_group", "n_lang", "v")))


def share(count: str, n: str, v: str = "v") -> Column:
    """p of the columns' values, exact: its products have up to 31 digits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({n} + 2 * {v} as decimal(20,0))")


def price(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


# --- one-hot level products ------------------------------------------------------------------------------------------

#: Columns of an indicator matrix at most, where a block can be divided further.
COLUMNS = 2048


def _levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each term in each group, first column of each group, level of each column) of a matrix of counts (terms x groups)."""
    place, first, level = np.empty(counts.shape, np.int64), [0], []
    for g in range(counts.shape[1]):
        names, place[:, g] = np.unique(counts[:, g], return_inverse=True)
        place[:, g] += first[-1]
        level.append(names)
        first.append(first[-1] + len(names))
    return place, np.array(first), np.concatenate(level)


def joint_levels(counts: np.ndarray, left: int, same: bool):
    """(g, h, a, b, n): n terms have count a in group g and b in group h, for g < left and, if same, each h > g, else each h >= left.

    Pairs of two zeros are left out. A run of terms with similar totals becomes an indicator matrix, whose transpose times itself has all these numbers;
    runs are divided until their matrix has at most COLUMNS columns or 16 terms."""
    counts = counts[np.argsort(counts.sum(1), kind="stable")]
    todo = [counts]
    while todo:
        part = todo.pop()
        place, first, level = _levels(part)
        if first[-1] > COLUMNS and len(part) > 16:
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
            continue
        one_hot = np.zeros((len(part), first[-1]), np.float32)
        one_hot[np.arange(len(part))[:, None], place] = 1
        group = np.repeat(np.arange(counts.shape[1]), np.diff(first))
        for g in range(left):
            lo = first[g + 1] if same else first[left]
            if lo == first[-1]:
                continue
            table = one_hot[:, first[g] : first[g + 1]].T @ one_hot[:, lo:]
            a, b = np.nonzero(table)
            some = (level[first[g] + a] > 0) | (level[lo + b] > 0)
            a, b = a[some], b[some]
            yield np.full(len(a), g), group[lo + b], level[first[g] + a], level[lo + b], table[a, b].astype(np.int64)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """From the rows of one block and pair of runs: (counts, numbers of the groups, their sums, groups of the left run, whether both runs are one)."""
    header = t["term"].is_null().to_numpy()
    g, n, total = (t[c].to_numpy() for c in ("g", "n", "n_group"))
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    names, at = np.unique(g[header], return_index=True)
    terms = t["term"].combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    counts = np.zeros((len(terms.dictionary), len(names)), np.int64)
    body = ~header
    counts[terms.indices.fill_null(0).to_numpy(zero_copy_only=False)[body], np.searchsorted(names, g[body])] = n[body]
    return counts, names, total[header][at], int((names // GROUPS == i).sum()), i == j


def _exact_share(count: int, n: int, v: int) -> int:
    return 1 + SCALE * (count + 2) // (n + 2 * v)


def _priced(t: pa.Table) -> pa.Table:
    """lang, g, h, value, terms: sums over the block's terms that at least one of the two groups holds."""
    counts, names, sums, left, same = _matrix(t)
    v, size = t["v"][0].as_py(), len(names)
    value, held = np.zeros((left, size), np.int64), np.zeros((left, size), np.int64)
    known: dict[tuple[int, int], int] = {}

    def shares(groups, levels):
        """p for each pair of a group and a level, in whole numbers of any size, once for each different pair."""
        keys = np.stack([groups, levels], 1)
        pairs, at = np.unique(keys, axis=0, return_inverse=True)
        found = []
        for g, c in pairs.tolist():
            if (g, c) not in known:
                known[g, c] = _exact_share(c, int(sums[g]), v)
            found.append(known[g, c])
        return np.array(found, np.int64)[at.reshape(-1)]

    for g, h, a, b, n in joint_levels(counts, left, same) if len(counts) else ():
        if len(g):
            p, q = shares(g, a), shares(h, b)
            np.add.at(value, (g, h), n * ((p - q) ** 2 // (p + q)))
            np.add.at(held, (g, h), n)
    a, b = np.triu_indices(size, 1) if same else (x.reshape(-1) for x in np.meshgrid(np.arange(left), np.arange(left, size), indexing="ij"))
    lang = pa.array([t["lang"][0].as_py()], pa.string()).take(pa.array(np.zeros(len(a), np.int32)))
    return pa.table({"lang": lang, "g": names[a], "h": names[b], "value": value[a, b], "terms": held[a, b]})


def _tables(t: pa.Table) -> pa.Table:
    counts, names, _, left, same = _matrix(t)
    found = list(joint_levels(counts, left, same)) if len(counts) else []
    g, h, a, b, n = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    lang = pa.array([t["lang"][0].as_py()], pa.string()).take(pa.array(np.zeros(len(g), np.int32)))
    return pa.table({"lang": lang, "g": names[g], "h": names[h], "a": a, "b": b, "n": n})


def _blocks(kept: DataFrame, groups: DataFrame):
    """Rows of kept terms, and a header row (null term) of each group, by language, pair (i, j) of runs of sources, and block of terms."""
    runs = groups.groupBy("lang").agg(F.max(F.expr(f"g div {GROUPS}")).alias("last"), F.max(F.expr(f"greatest(1, (v + {TERMS - 1}) div {TERMS})")).alias("blocks"))
    own = groups.join(small(runs), "lang")
    met = lambda df: (
        df.withColumn("run", F.expr(f"g div {GROUPS}"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        .select("lang", F.least("run", "other").alias("i"), F.greatest("run", "other").alias("j"), "block", "term", "g", "n", "n_group", "v")
    )
    body = kept.join(small(own), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    head = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long"))
    return met(body).unionByName(met(head)).groupBy("lang", "i", "j", "block")


def joint_tables(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, a, b, n for g < h: n kept terms occur a times in group g and b times in group h, two zeros included. The n of a pair add up to v."""
    found = _blocks(kept, groups).applyInArrow(_tables, "lang string, g long, h long, a long, b long, n long").groupBy("lang", "g", "h", "a", "b").agg(F.sum("n").alias("n"))
    found = written(found, "joint")
    side = lambda c: groups.select("lang", F.col("g").alias(c), "v")
    held = found.groupBy("lang", "g", "h").agg(F.sum("n").alias("held"))
    pairs = side("g").join(side("h").drop("v"), "lang").where("g < h").join(held, ["lang", "g", "h"], "left")  # a row for each pair of sources, as the result has
    zeros = pairs.select("lang", "g", "h", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("v") - F.coalesce("held", F.lit(0))).alias("n")).where("n > 0")
    return found.unionByName(zeros)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each two sources of a language over all kept terms, in both directions."""
    sums = _blocks(kept, groups).applyInArrow(_priced, "lang string, g long, h long, value long, terms long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    side = lambda c, s: small(groups.select("lang", F.col("g").alias(c), F.col("source").alias(s), F.col("n_group").alias(f"n_{c}"), "v"))
    both = sums.join(side("g", "source"), ["lang", "g"]).join(side("h", "item").drop("v"), ["lang", "h"])
    both = both.withColumn("zero", F.lit(0)).withColumn("p", F.when(F.col("v") > 0, share("zero", "n_g"))).withColumn("q", F.when(F.col("v") > 0, share("zero", "n_h")))
    rest = F.coalesce((F.col("v") - F.col("terms")) * price("p", "q"), F.lit(0))  # terms that neither group holds
    both = both.select("lang", "source", "item", (F.col("value") + rest).alias("value"))
    return both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")


def term_values(kept: DataFrame, groups: DataFrame, most: int = 10) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source has more of than its language, by what they add to its divergence from it."""
    rows = kept.join(small(groups), ["lang", "source"]).withColumn("p", share("n", "n_group")).withColumn("q", share("total", "n_lang")).where("n > 0 and p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), price("p", "q").alias("value"))
    return rows.withColumn("rank", _rank()).where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = written(kept_counts(term_counts(docs, text_col, lang_col, source_col), least), "kept-terms")
    groups = written(group_sums(docs, kept, lang_col, source_col), "groups")
    pairs = pair_values(kept, groups).withColumn("rank", _rank())
    terms = term_values(kept, groups, most)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row_id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
ln AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total FROM ln GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v) AS BIGINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
u AS (SELECT * FROM allpairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
