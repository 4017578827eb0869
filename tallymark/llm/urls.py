"""URL filtering: host and path rules, then a list of URLs behind a blocked Bloom filter.

The list is of any size and is never broadcast.  Its Bloom filter is: at most
``max_blocks`` words of 64 bits, each word a block in which a URL sets four
bits, so one lookup answers.  Only possible hits go on to an exact hash join
with the list, which removes false positives; a filter too small for its list
lets more rows through to the join but changes no verdict.

Defined results: a null URL, or one without ``://``, has an empty host and path
and meets no rule and no listed URL: it is allowed.  Repeated rows are judged
alike; null or repeated list entries count once; an empty list blocks nothing;
other columns stay, but ``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and port, path without a closing slash or ``.html``; null for an empty host."""
    bare = F.regexp_replace(host, r"^www\.|:\d*$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html?|/+)$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> Column:
    """The four bits that a URL sets in its block."""
    h = F.xxhash64(F.lit(1), key)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, k), F.lit(64)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def blocked_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, word: the filter of ``keys.key``, a row for each block in use."""
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    return keys.select(block, _bits(F.col("key")).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", max_blocks: int = 1 << 18) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``listed.url`` holds the URLs to block."""
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).where("key is not null").distinct()
    keys = materialize(keys, "listed")
    n_blocks = min(max_blocks, max(64, keys.count() // 4))
    bloom = F.broadcast(blocked_bloom(keys, n_blocks))  # at most max_blocks rows of 16 bytes

    url, rows = F.col(url_col), pages.drop("host", "path", "rule", "verdict")
    seen = rows.withColumn("_host", host_of(url)).withColumn("_path", path_of(url))
    rule, said = rule_of(F.col("_host"), F.col("_path"), rules)
    seen = seen.withColumn("_rule", rule).withColumn("_said", said)
    seen = seen.withColumn("_key", F.when(F.col("_rule").isNull(), canonical(F.col("_host"), F.col("_path"))))
    seen = seen.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(n_blocks))).withColumn("_bits", _bits(F.col("_key")))
    looked = seen.join(bloom.select(F.col("block").alias("_block"), F.col("word").alias("_word")), "_block", "left")
    possible = F.coalesce(F.col("_key").isNotNull() & (F.col("_word").bitwiseAND(F.col("_bits")) == F.col("_bits")), F.lit(False))
    looked = looked.withColumn("_possible", possible)
    names = [*(F.col(c) for c in rows.columns), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), "verdict"]
    clear = looked.where(~F.col("_possible")).withColumn("verdict", F.coalesce("_said", F.lit("allow")))
    hits = looked.where("_possible").join(keys.select(F.col("key").alias("_listed")).hint("shuffle_hash"), F.col("_key") == F.col("_listed"), "left")
    hits = hits.withColumn("verdict", F.when(F.col("_listed").isNotNull(), "block").otherwise("allow"))
    return clear.select(names).unionByName(hits.select(names))
