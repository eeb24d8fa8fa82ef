"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontamination, language, mixing, neardup, sharding
from tessera.llm.common import discard, row_key, small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates are documents whose five-word shingle sets have this similarity or more, in per cent.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter. `lang` becomes the predicted language.

    Repeated rows are predicted each; ties between languages go to the first by code point; null ids stay; other columns of docs, whatever their
    names, are left out, here and in all stages; an empty table stays empty."""
    found = language.identified(docs.select(COLUMNS), language.learn(docs))
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, SIMILAR) the document with the smallest doc_id stays, once: of rows with equal id and text one stays.

    Rows of one id with different texts stay or go together: they go if no row of the id is the smallest of its group. Rows with a null id
    are linked with nothing and stay, as do those with a null or empty text unless their id goes. Very long texts are compared whole. Of equal rows of an id
    the one that comes first by n_chars, lang and source stays. An empty table stays empty."""
    docs = docs.select(COLUMNS)
    found = written(neardup.near_duplicates(docs, SIMILAR).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("doc_id is not null and (not kept or n > 1)"), "dedup")
    kept = docs.join(small(found.where("not kept").select("doc_id")), "doc_id", "left_anti")
    again = found.where("kept").select("doc_id")
    if again.isEmpty():
        return kept.select(COLUMNS)
    again = small(again)
    same = F.md5(F.coalesce("text", F.lit("")))  # aggregated before the shuffle: copies of one id are no group of their own
    rest = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", same.alias("same")).agg(F.min(F.struct("n_chars", "lang", "source", "text")).alias("row")).select("doc_id", "row.*")
    return kept.join(again, "doc_id", "left_anti").select(COLUMNS).unionByName(rest.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Repeated rows are judged each, null ids like others; an empty benchmark or table changes nothing.

    Null and empty texts stay; very long ones are read whole. Several items in one document are no tie: one is enough. Columns of docs beside those of documents are left out."""
    return decontamination.matched(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """docs with row_key: equal for rows of equal id, text and source only. Copies of a text are neighbours."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select(*COLUMNS, F.concat(row_key(F.col("doc_id"), F.col("text")), F.substring(F.md5(source), 1, 8)).alias("row_key"))


def _ranges(rows: DataFrame, names: list[str], low: str, high: str) -> DataFrame:
    """The different rows (row_key, names ...), each with its range of numbers [low, high) among those of its key, as wide as the row is frequent.

    Two levels: numbers of rows by a hash of the row, and running sums within each, so that no key is a single group."""
    counted = rows.groupBy("row_key", *names).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64(*names), F.lit(256)))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("row_key", "part").agg(F.sum("n").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before("row_key").orderBy("part")), F.lit(0))).drop("m")
    at = F.col("start") + F.coalesce(F.sum("n").over(before("row_key", "part").orderBy(*names)), F.lit(0))
    return counted.join(parts, ["row_key", "part"]).withColumn(low, at).withColumn(high, F.col(low) + F.col("n")).drop("start", "n", "part")


#: Copies of a row that are made at once.
_COPIES = 4096


def _met(docs: DataFrame, decisions: DataFrame, names: list[str]) -> DataFrame:
    """docs (with row_key) with their rows of decisions (row_key, names ...): repeated rows get one each, by their number on both sides. The texts are shuffled once.

    Only keys of repeated rows are numbered; all others join as they are. Rows of a key differ in n_chars and lang at most (and in a text that is null or empty):
    ranges of such narrow rows meet ranges of decisions, and the text of a key, aggregated to one row, joins afterwards."""
    repeated = small(written(decisions.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"), "repeated"))
    out = docs.join(repeated, "row_key", "left_anti").join(decisions.select("row_key", *names), "row_key")
    again = docs.join(repeated, "row_key", "left_semi").withColumn("blank", F.col("text").isNull())
    texts = again.groupBy("row_key", "blank").agg(F.min(F.struct("doc_id", "text", "source")).alias("of"))
    mine = _ranges(again, ["n_chars", "lang", "blank"], "low", "high")
    each = _ranges(decisions.join(repeated, "row_key", "left_semi"), names, "first", "last")
    many = each.join(mine, "row_key").withColumn("copies", F.least("high", "last") - F.greatest("low", "first")).where("copies > 0")
    many = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES)))).join(texts, ["row_key", "blank"])
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("copies") - F.col("block") * _COPIES))))
    return out.select(*COLUMNS, *names).unionByName(many.select("of.doc_id", "of.text", "lang", "of.source", "n_chars", *names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix reads it: the words taken over its words, rounded. Documents without words go.

    Repeated rows are rows of their source each; a null source is one of its own; rows without an id are ordered by text. Rows are met by id, text and source.
    Null and empty texts have no words and go; very long texts count whole. Ties between quotas go to the first source by code point. An empty table stays empty."""
    keyed = _named(docs)
    mixed = mixing.mix(keyed.select("row_key", "text", "source"), id_col="row_key")
    times = mixed.select(F.col("doc_id").alias("row_key"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("times"))
    return _met(keyed, written(times, "mix-times"), ["times"]).where("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1), "times"))).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size in bytes, shard and slot. Copies of a text share a shard unless they are larger than one; repeated rows get a slot each.

    Null ids are rows like others; null and empty texts have the size of a record without text; a text larger than a shard stays whole. Slots are dealt by key, so
    rows tied on id, text and source take neighbouring slots in any order. An empty table stays empty."""
    keyed = _named(docs)
    placed = sharding.sharded(keyed, key_col="row_key").select(F.col("key").alias("row_key"), "size", "shard", "slot")
    return _met(keyed, placed, ["shard", "slot", "size"])


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Suffix automata are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table that the next one reads, and that is deleted once the next has written its own."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if last is not None:
                discard(last)
            last = docs
    return docs
