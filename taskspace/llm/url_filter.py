"""URL rules behind a blocked Bloom filter, in DataFrame expressions only.

Rules are (host, path, verdict). A url's candidate keys are the suffixes of its host with as many labels as rules
have, each with the prefixes of its path at the lengths that rules have. The filter drops keys that no rule can have; an exact hash join
removes what it passed by chance; the longest rule that is left wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is eight words of 64 bits; a key sets one bit in each.
WORDS = 8
#: The most blocks of a filter, 8 MB.
LARGEST = 1 << 17
#: Joins host and path of a key; no url part holds it unescaped at a label border.
_SEP = "\u0001"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(_SEP), path)


def _labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bit(key: Column, word: int) -> Column:
    """The bit, 0 to 63, that a key sets in a word of its block: six bits of a second hash for each word."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")


def blocks_for(keys: int) -> int:
    """Blocks, a power of two, that give each key 16 bits or more: false hits stay below one in a thousand or so. At least 64, and
    at most LARGEST, beyond which more keys only send more to the exact join."""
    need = -(-max(keys, 1) * 16 // (64 * WORDS))
    return min(LARGEST, max(64, 1 << (need - 1).bit_length()))


def bloom_filter(rules: DataFrame, host: str, path: str, blocks: int) -> DataFrame:
    """One row: ``words``, the filter's 64-bit words. Its size depends on ``blocks`` alone; more keys only raise the rate of false hits."""
    key = _key(F.col(host), F.col(path))
    bits = [F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)]
    by_block = rules.select(_block(key, blocks).alias("block"), *[_bit(key, i).alias(f"b{i}") for i in range(WORDS)]).groupBy("block").agg(*bits)
    entry = F.struct(F.col("block"), F.array(*[F.col(f"w{i}") for i in range(WORDS)]).alias("w"))
    packed = by_block.agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    empty = F.array(*[F.lit(0).cast("long")] * WORDS)
    return packed.select(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda b: F.coalesce(F.try_element_at("m", b), empty))).alias("words"))


def maybe_listed(key: Column, words: Column, blocks: int) -> Column:
    """False only if the key is in no rule."""
    base = (_block(key, blocks) * WORDS).cast("int")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.getbit(F.element_at(words, base + F.lit(i + 1)), _bit(key, i)) == 1)
    return hit


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to pages.

    ``rules`` has host, path and verdict (strings). A rule fits its host and all subdomains where the url's path starts
    with the rule's; the longest rule (its text's length, then host's, then text order) wins; a rule given twice counts
    once, with the smaller verdict. Without one the rule is null and the verdict ``default``. Null urls, urls without
    ``://`` and empty tables are fine; repeated pages each keep their row. Columns of pages with an output's name are replaced.
    Very long urls and hosts are fine: keys are cut only
    at the lengths that some rule's path has and behind as many labels as some rule's host has. The filter has ``blocks`` blocks of
    512 bits, by default as many as the count of rules asks for.

    Only keys that pass the filter are shuffled, once a task each, whatever the number of pages that have them;
    pages themselves move once, in a left join that adaptive execution may split. Rules join by hash; Spark broadcasts
    them only where its statistics show them under its own threshold.
    """
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").where("r_host is not null and r_path is not null")
    listed = listed.groupBy("r_host", "r_path").agg(F.min("verdict").alias("r_verdict"))
    blocks = blocks or blocks_for(listed.count())
    words = bloom_filter(listed, "r_host", "r_path", blocks).scalar()
    # one number for each length that a rule's path has
    sizes = listed.agg(F.sort_array(F.collect_set(F.length("r_path")))).scalar()
    # and for each count of labels that a rule's host has
    depths = listed.agg(F.sort_array(F.collect_set(_labels(F.col("r_host"))))).scalar()
    located = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    n, m, h, p, v = unused(located, "n", "m", "h", "p", "v")
    suffixes = F.transform(F.filter(F.col(m), lambda k: k <= _labels(F.col("host"))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(F.col(n), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _key(h, p))))
    asked = located.withColumns({n: sizes, m: depths}).select("host", "path", F.explode(keys).alias("key")).where(maybe_listed(F.col("key"), words, blocks)).distinct()
    exact = asked.join(listed.withColumn("key", _key(F.col("r_host"), F.col("r_path"))), "key")
    rule = F.concat("r_host", "r_path")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(rule), F.length("r_host"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    found = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best.rule").alias("rule"), F.col("best.verdict").alias(v))
    joined = located.join(found, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return joined.withColumn("verdict", F.coalesce(v, F.lit(default))).drop(h, p, v)
