"""URL filters: rules on hosts and paths, and a list of canonical URLs.

The list is looked up in two steps. A blocked Bloom filter, one 256-bit block per
URL and two bits in each of its four words, is broadcast and passes every listed
URL and a few others; it has at most ``MAX_BLOCKS`` blocks of 40 bytes whatever the
list holds, so a longer list costs more false hits and no memory. Only the
possible hits are then joined with the list itself, by the whole canonical URL,
which removes the false ones. Both are stored tables, so the rows of a frequent URL are
split by adaptive execution.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is on no list. Repeated rows are judged alike. Nulls in the list
are ignored, and an empty list or table is fine. Only the id and url columns are
read, so extra columns never clash.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cropline.llm.common import column
from cropline.session import materialise

KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 17
SEED = 7


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str = "/"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", column(url))
    rest = F.when(at > 0, column(url).substr(at + 3, F.length(column(url)))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return (
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def canonical(url: str) -> Column:
    """Host without ``www.`` or ``m.`` and default port, path without a closing
    slash, other parameters than tracking ones in order; no scheme or fragment.
    Null if the url has no host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(column(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, F.regexp_replace(path, r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text = verdict = F.lit(None).cast("string")
    # The last one asked wins, so longer rules are asked later.
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _masks(key: str) -> list[Column]:
    """Two bits for each of the four words of a key's block."""
    bits = F.xxhash64(F.lit(SEED + 1), F.col(key))
    words = []
    for i in range(4):
        first, second = (F.shiftrightunsigned(bits, 12 * i + 6 * j).bitwiseAND(F.lit(63)) for j in range(2))
        words.append(_bit(first).bitwiseOR(_bit(second)))
    return words


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(_block, _w0 .. _w3)`` of the blocked Bloom filter of a column."""
    marked = keys.select(_block(key, blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(key))])
    return marked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(4)])


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(blocks).cast("bigint"))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """Judge every url: ``_id``, ``host``, ``path``, ``canonical``, ``listed``,
    ``rule``, ``verdict``.

    ``listed`` has one column of canonical URLs. The verdict is that of the longest
    rule that fits, else ``block`` for listed URLs and ``allow`` for others.
    """
    names = materialise(listed.select(column(listed.columns[0]).alias("_listed")).filter("_listed IS NOT NULL").distinct())
    count, blocks = names.count(), 1
    while blocks * KEYS_PER_BLOCK < count and blocks < MAX_BLOCKS:
        blocks *= 2
    bloom = bloom_blocks(names, "_listed", blocks).withColumnRenamed("_block", "_b")
    host, path = host_and_path(url_column)
    read = pages.select(
        column(id_column).alias("_id"), host.alias("host"), path.alias("path"), canonical(url_column).alias("canonical")
    )
    probed = read.withColumn("_block", _block("canonical", blocks)).join(
        F.broadcast(bloom), F.col("_block") == F.col("_b"), "left"
    )
    possible = F.col("canonical").isNotNull() & F.col("_b").isNotNull()
    for i, mask in enumerate(_masks("canonical")):
        possible = possible & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    columns = ["_id", "host", "path", "canonical"]
    # Urls are taken apart once; both branches read the stored parts.
    probed = materialise(probed.select(*columns, possible.alias("_hit")))
    hits = probed.filter("_hit").select(*columns)
    exact = hits.join(names, F.col("canonical") == F.col("_listed"), "left")
    found = exact.select(*columns, F.col("_listed").isNotNull().alias("listed"))
    judged = found.unionByName(probed.filter("NOT _hit").select(*columns, F.lit(False).alias("listed")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_list))
