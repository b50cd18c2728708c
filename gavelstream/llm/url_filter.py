"""URL filters: a blocked Bloom filter passes what may be listed to an exact join. Only DataFrame functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import stash

#: A block has so many longs, and a key sets one bit in each.
WORDS = 8
#: Bits of the filter for each key, as long as the filter stays within its bound.
BITS_A_KEY = 16
#: Blocks at most: with their numbers they take about 12 MB where they are broadcast.
MOST_BLOCKS = 2**17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def url_host(url: str) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: str) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(host: str, path: str) -> Column:
    """Host without www., path without slashes at its end: addresses that differ otherwise name one page."""
    return F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(path, "/+$", ""))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """url: the canonical addresses under which pages has more than one row (column url)."""
    addresses = pages.select(url_host("url").alias("host"), url_path("url").alias("path")).where("host <> ''").select(canonical("host", "path").alias("url"))
    return addresses.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n_blocks))


def _bit(word: int) -> Column:
    """The bit that the column key sets in a word of its block, as a long of that bit alone."""
    place = F.shiftrightunsigned(F.xxhash64("key", F.lit(word // 4)), 6 * (word % 4)).bitwiseAND(63)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0 to w7 for the keys of listed; blocks without keys have no row. Tasks OR their own keys first."""
    return listed.groupBy(_block(n_blocks).alias("block")).agg(*[F.bit_or(_bit(w)).alias(f"w{w}") for w in range(WORDS)])


def possible_hits(rows: DataFrame, listed: DataFrame, bits_a_key: int = BITS_A_KEY, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows whose column key may be among listed's: all that are, and few others.

    The filter grows with the list up to most_blocks, so that what is broadcast
    is bounded. A longer list lets more through, which costs the join behind it
    and changes no result.
    """
    n_blocks = min(most_blocks, max(1, -(-listed.count() * bits_a_key // (64 * WORDS))))
    near = rows.withColumn("block", _block(n_blocks)).join(F.broadcast(bloom_blocks(listed, n_blocks)), "block")
    for w in range(WORDS):
        near = near.where(F.col(f"w{w}").bitwiseAND(_bit(w)) != 0)
    return near.select(rows.columns)


def _rule_keys(longest_host: int, longest_path: int) -> Column:
    """The keys of all rules that can fit the columns host and path: an end of the host from a label on, and a beginning of the path."""
    host, path = F.col("host"), F.col("path")
    tail = F.right(host, F.lit(longest_host + 1))
    none = F.array().cast("array<string>")
    dots = F.filter(F.sequence(F.lit(1), F.length(tail)), lambda i: F.substring(tail, i, F.lit(1)) == ".")
    ends = F.when(F.length(tail) > 0, F.transform(dots, lambda i: F.substring(tail, i + 1, F.lit(longest_host)))).otherwise(none)
    whole = F.when(F.length(host) <= longest_host, F.array(host)).otherwise(none)
    begins = F.transform(F.sequence(F.lit(0), F.least(F.length(path), F.lit(longest_path))), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(F.concat(whole, ends), lambda e: F.transform(begins, lambda b: F.concat(F.lit("rule "), e, b))))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    rules has host, path and verdict (allow or block). A rule fits its host and
    all subdomains of it, if the page's path starts with the rule's; of those
    that fit the longest decides (host and path together; of equal ones that
    with the longer host; of rules with one host and path block wins), and
    `rule` names it. Where none fits the page is blocked if listed's column url
    has its canonical address, else allowed.

    A url that is null or without :// has empty host and path, which no rule
    fits and no list blocks. Rows that repeat a page_id, or have none, are
    judged each by itself; other columns of pages are ignored, whatever their
    names; empty pages give none, and empty rules and lists allow all. Nulls
    among rules' columns count as empty hosts and paths, which fit nothing; null
    addresses are left out.

    Each page becomes a row per key that could be listed (the ends of its host
    and beginnings of its path, no longer than the longest rule's), and the
    filter drops all but possible hits where they are read. Hits meet the list
    in an equi-join, which Spark divides for a hot rule, and are brought to one
    per page by partial maxima.
    """
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    named = rules.select(F.concat(F.lit("rule "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), "verdict")
    no_number = F.lit(0).alias("host_chars"), F.lit(0).alias("path_chars")
    urls = listed.where("url IS NOT NULL").select(F.concat(F.lit("url "), "url").alias("key"), F.lit(None).cast("string").alias("rule"), *no_number, F.lit("block").alias("verdict")).distinct()
    entries = stash(named.unionByName(urls), "listed-urls")
    longest_host, longest_path = entries.agg(F.coalesce(F.max("host_chars"), F.lit(0)), F.coalesce(F.max("path_chars"), F.lit(0))).first()

    # the pages' numbers are written, as two parts of the plan below read them
    rows = stash(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", url_host("url").alias("host"), url_path("url").alias("path")), "urls")
    known = rows.where("host <> ''")
    keys = F.concat(_rule_keys(longest_host, longest_path), F.array(F.concat(F.lit("url "), canonical("host", "path"))))
    asked = known.select("row", F.explode(keys).alias("key"))
    hits = possible_hits(asked, entries.select("key"), most_blocks=most_blocks).join(entries, "key")
    first = F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("chars"), "host_chars", "rule", "verdict")
    best = hits.groupBy("row").agg(F.max(first).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
