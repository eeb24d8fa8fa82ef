"""Token counts: an exact histogram of encoded lengths, with suffix sums.

Each document is encoded once, whole, by a public byte-level vocabulary; only its length leaves the task. The histogram
has a row for each length that occurs. Its suffix sums (documents and tokens at this length or more) answer, for any
context limit, how many tokens there are in all, how many remain when every document is cut at the limit, and what share
of documents fits; quantiles are read off the same table.

Scale: one pass over the text without a shuffle of it; counts are combined before their shuffle. The suffix sums have two levels
(1,024 lengths to a part), so that no task sorts the whole histogram.

Edge cases: a null or empty text has length 0 and is counted there. Repeated rows count each time. An empty table gives an
empty histogram. Very long texts are encoded whole. Special tokens' spellings are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before byte-pair merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PART = 1024


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's bytes; by default that of the installed public tokenizers. Under 1 MB: it travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def _lengths(held, pattern: str):
    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in held.value.splitlines() if line)}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(n, np.int64))], ["n_tokens"])

    return count


def encoded_lengths(docs: DataFrame, path: str | None = None, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """n_tokens of each row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return small_batches(docs.select(F.col(text_col).cast("string"))).mapInArrow(_lengths(held, pattern), "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Per length: docs; docs and tokens at least as long; truncated_total, the tokens left when all are cut at it; fitting, the share not longer."""
    counts = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "lengths").withColumn("part", F.expr(f"n_tokens div {PART}"))
    parts = counts.groupBy("part").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    later, whole = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"], F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    down = Window.partitionBy("part").orderBy(F.desc("n_tokens"))
    return (
        counts.join(parts, "part")
        .withColumn("docs_at_least", F.col("later_d") + F.sum("docs").over(down))
        .withColumn("tokens_at_least", F.col("later_t") + F.sum(F.col("docs") * F.col("n_tokens")).over(down))
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("fitting", (F.col("total_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("total_docs"))
        .select("n_tokens", "docs", "docs_at_least", "tokens_at_least", "truncated_total", "fitting", "total_docs", "total_tokens")
    )


def for_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents longer than it, tokens left when documents are cut at it, and all tokens."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long").crossJoin(hist.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens")))
    above = asked.select("context").join(hist, hist["n_tokens"] > F.col("context"), "left")  # a few limits against the histogram
    sums = above.groupBy("context").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("longer"), F.coalesce(F.sum(F.col("docs") * (F.col("n_tokens") - F.col("context"))), F.lit(0)).alias("lost"))
    return asked.join(sums, "context").select("context", "longer", (F.col("total_tokens") - F.col("lost")).alias("truncated_total"), "total_tokens", "total_docs")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Per share: the smallest length that at least this share of the documents does not exceed."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(hist, hist["fitting"] >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_histogram(spark, sf_dir) -> DataFrame:
    return histogram(encoded_lengths(table(spark, sf_dir, "documents")))
