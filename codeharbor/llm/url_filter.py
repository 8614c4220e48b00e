"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks (four longs), built by bit_or per block; a URL sets and needs two
bits in each long of one block. A filter of at most PACKED blocks is packed into arrays and probed where
the pages are scanned, so only possible hits are shuffled; a larger one is probed by a join on the
block number. What may be listed then meets the list itself in an exact join, which removes the false
positives.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import ascii_lower, written

BITS_PER_URL, BLOCK_BITS = 16, 256
PACKED = 1 << 16  # blocks, together 2 MB
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host and path and query without a www. or m. label, tracking parameters, fragment or closing slash.

    Null for a URL without a host.
    """
    site = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref)(=|$)")), "&")
    page = F.regexp_replace(path(url), r"/+$", "")
    return F.when(site != "", F.concat(site, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule(at: Column, page: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits a host or its parent domain and a path, or null."""
    found = F.lit(None)
    for site, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((at == site) | at.endswith("." + site)) & page.startswith(start)
        found = F.when(fits, F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _hashed(urls: DataFrame, blocks: int, *others: str) -> DataFrame:
    """(others, url, block, m0..m3): the block of a URL and its bits there."""
    bits = F.xxhash64(F.lit("bits"), "url")
    mask = [
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {12 * i}) & 63 AS int)) | shiftleft(1L, cast(shiftrightunsigned(_h, {12 * i + 6}) & 63 AS int))").alias(f"m{i}")
        for i in range(4)
    ]
    return urls.select(*others, "url", F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), bits.alias("_h")).select(*others, "url", "block", *mask)


def bloom(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter of urls(url)."""
    return _hashed(urls, blocks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def possible(urls: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The urls(url) that the filter lets through: all that are in it, and a few more."""
    hit = " AND ".join(f"w{i} & m{i} = m{i}" for i in range(4))
    return _hashed(urls, blocks).join(words, "block").filter(hit).select("url")


def packed(words: DataFrame, blocks: int) -> Column:
    """The filter of at most PACKED blocks as one value: a struct of four arrays by block number."""
    every = words.sparkSession.range(blocks).withColumnRenamed("id", "block").join(words, "block", "left")
    rows = F.sort_array(F.collect_list(F.struct("block", *[F.coalesce(f"w{i}", F.lit(0)).cast("long").alias(f"w{i}") for i in range(4)])))
    made = every.agg(rows.alias("rows")).select(F.struct(*[F.col("rows")[f"w{i}"].alias(f"w{i}") for i in range(4)]).alias("words"))
    return written(made).scalar()


def listed(urls: DataFrame, sites: list[str]) -> DataFrame:
    """Canonical URLs, once each, on hosts with one of the site names as a label."""
    pattern = rf"(^|\.)({'|'.join(sites)})(\.|$)"
    return urls.filter(host(F.col("url")).rlike(pattern)).select(canonical(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()


def judge(pages: DataFrame, block_list: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict.

    The longest rule decides; without one, a URL whose canonical form is in block_list(url) is
    blocked and any other allowed. A null URL, or one without ://, has empty host and path and is
    allowed unless a rule fits. Repeated rows are judged each.
    """
    at, page = host(F.col(url)), path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), at.alias("host"), page.alias("path"), canonical(F.col(url)).alias("canon"))
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    settled = rows.filter("found IS NOT NULL OR canon IS NULL").selectExpr(f"key AS `{key}`", "host", "path", "found.rule AS rule", "coalesce(found.verdict, 'allow') AS verdict")
    asked = rows.filter("found IS NULL AND canon IS NOT NULL").withColumnRenamed("canon", "url")
    names = written(block_list.filter("url IS NOT NULL").select("url").distinct())
    blocks = names.count() * BITS_PER_URL // BLOCK_BITS + 1
    words = bloom(names, blocks)
    hashed = _hashed(asked, blocks, "key", "host", "path")
    if blocks <= PACKED:
        told = packed(words, blocks)
        tests = [F.get(told[f"w{i}"], F.col("block").cast("int")).bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(4)]
        tested = hashed.select("key", "host", "path", "url", reduce(and_, tests).alias("maybe"))
    else:
        hit = " AND ".join(f"w{i} & m{i} = m{i}" for i in range(4))
        tested = written(hashed.join(words, "block", "left").select("key", "host", "path", "url", F.coalesce(F.expr(hit), F.lit(False)).alias("maybe")))
    clear = tested.filter("NOT maybe").selectExpr(f"key AS `{key}`", "host", "path", "cast(NULL AS string) AS rule", "'allow' AS verdict")
    checked = tested.filter("maybe").join(names.withColumn("hit", F.lit(True)), "url", "left")
    checked = checked.selectExpr(f"key AS `{key}`", "host", "path", "cast(NULL AS string) AS rule", "if(hit, 'block', 'allow') AS verdict")
    return settled.unionByName(clear).unionByName(checked)
