"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter is a table: row b holds block b, eight 32-bit words; a key sets one bit in each word of one block. A URL that
misses a bit is surely not listed and never reaches the join; the possible hits meet the list in an exact join on the
canonical URL, which removes false positives.

Scale: the filter has at most MAX_BLOCKS blocks of 40 bytes, whatever the length of the list (a longer list only raises
the share of false positives), so broadcasting it is bounded. Pages are read once, into a narrow table of parts and filter answers; possible hits
from there are joined by shuffle; the list, a table too, has one row
per canonical URL, and Spark's skew join splits a URL that a third of the pages share.

The list is a parameter. The query lists the canonical URLs of pages whose html is noisy (`noisy_list`), so that the list does not follow from
the URLs: other pages under the same canonical URL are blocked with them.

Edge cases: a url that is null or has no `://` has an empty host and path, fits no rule, has no canonical form and is
allowed. Repeated rows get a verdict each. A null html has no marks. Rules of equal length that both fit: the later one of the list. Very long urls and html
are read whole. An empty list blocks nothing; an empty table gives an empty result. Columns of pages with the names used here do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

MAX_BLOCKS = 1 << 19
BITS_PER_URL = 16

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: A host label with one of these words puts a page's URL on the list.
LISTED_WORDS = ("pills", "casino", "spam")

#: Signs in groups of three, as noise leaves them behind words, and how many of them make a page's html noisy.
MARK, MARKS = r"%%%|###|\*\*\*|\$\$\$", 20

# Fixed odd multipliers, one per word of a block; any odd values do.
_ODD = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3, F.lit(1 << 30)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without leading `www.`, `m.` or `blog.`, then the path without a closing `/` or `.html`; no scheme, query or fragment."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www\.|m\.|blog\.)", ""), F.regexp_replace(path, r"(/|\.html)$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as `host/path`; null without one. The rules are a short list in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _hashed(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.shiftright(h, 32), F.lit(n_blocks)).cast("int")
    # The multiplier's product stays within 64 bits: the low half is cut to 31 bits first.
    masks = [F.expr(f"shiftleft(1, cast(shiftright((h31 * {odd}L) & 4294967295, 27) as int))") for odd in _ODD]
    return (block, low), masks


def with_bits(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """df with its block number and the bit of each of the eight words."""
    (block, low), masks = _hashed(F.col(key), n_blocks)
    df = df.withColumn("block", block).withColumn("h31", low.bitwiseAND(F.lit(0x7FFFFFFF)))
    return df.withColumns({f"bit{i}": m for i, m in enumerate(masks)}).drop("h31")


def bloom_filter(listed: DataFrame, n_blocks: int, key: str = "canon") -> DataFrame:
    return with_bits(listed.select(key), key, n_blocks).groupBy("block").agg(*[F.bit_or(f"bit{i}").alias(f"word{i}") for i in range(8)])


def block_listed(pages: DataFrame, listed: DataFrame, key: str = "canon") -> DataFrame:
    """pages with `is_listed`. listed has the column canon, distinct and without nulls. Both are computed once, into tables that the result reads."""
    listed = written(listed.select(key), "listed")
    n = listed.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_URL // 256)))
    bloom = bloom_filter(listed, n_blocks, key)
    rows = pages.select(F.struct("*").alias("row"), F.col(key).alias("canon"))  # no column of pages can clash
    bits = with_bits(rows, "canon", n_blocks).join(F.broadcast(bloom), "block", "left")  # at most MAX_BLOCKS rows of 40 bytes
    possible = F.coalesce(F.expr(" and ".join(f"word{i} & bit{i} = bit{i}" for i in range(8))), F.lit(False))
    bits = written(bits.select("row", "canon", (possible & F.col("canon").isNotNull()).alias("possible")), "url-bits")
    hits = bits.where("possible").join(listed.select(F.col(key).alias("canon"), F.lit(True).alias("hit")), "canon", "left")
    rest = bits.where("not possible").select("row", F.lit(False).alias("hit"))
    return hits.select("row", F.coalesce("hit", F.lit(False)).alias("hit")).unionByName(rest).select(*[F.col("row")[c].alias(c) for c in pages.columns if c != "is_listed"], F.col("hit").alias("is_listed"))


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, is_listed of every page."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("canon", canonical(F.col("host"), F.col("path"))).withColumn("rule", rule).withColumn("rule_verdict", verdict)
    method = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return block_listed(parts, listed).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "is_listed")


def word_list(pages: DataFrame, words=LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """Canonical URLs of the pages whose host has one of the words."""
    url = F.col(url_col)
    return pages.select(host_of(url).alias("host"), path_of(url).alias("path")).where(F.col("host").rlike("|".join(words))).select(canonical(F.col("host"), F.col("path")).alias("canon")).distinct()


def noisy_list(pages: DataFrame, marks: int = MARKS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Canonical URLs of the pages whose html has at least so many marks: the list that the query uses."""
    url = F.col(url_col)
    noisy = pages.where(F.regexp_count(F.col(html_col), F.lit(MARK)) >= marks)
    return noisy.select(canonical(host_of(url), path_of(url)).alias("canon")).where("canon is not null").distinct()


def op3_url_filter(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), noisy_list(pages))


OP3_SQL = r"""
WITH s AS (SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '%%%|###|\*\*\*|\$\$\$')) AS marks, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS tail FROM pages),
p AS (
  SELECT page_id, marks,
    translate(coalesce(regexp_extract(tail, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www\.|m\.|blog\.)', '') || regexp_replace(path, '(/|\.html)$', '') END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE marks >= 20 AND canon IS NOT NULL),
r AS (
  SELECT c.* EXCLUDE (marks), CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    l.canon IS NOT NULL AS is_listed
  FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed
FROM r
"""
