"""Which names contain which words, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions.joins import fits_broadcast, split_hot_keys
from cropline.session import materialise

REGEX_BLOCKS = 64
# Characters of the pieces that words and names are joined by.
GRAM = 3


def _words(df: DataFrame, word: str) -> DataFrame:
    return df.select(word).filter(F.length(word) > 0).distinct()


def grams(texts: DataFrame, text: str, sizes: Column) -> DataFrame:
    """``texts`` with every different ``_gram`` of the text that has one of ``sizes``: fewer
    than the text has characters, for each size."""
    last = F.length(text) - F.col("_size") + 1
    cut = F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(F.col(text), at, F.col("_size")))
    return (
        texts.withColumn("_size", F.explode(sizes))
        .filter(last >= 1)
        .withColumn("_gram", F.explode(F.array_distinct(cut)))
        .drop("_size")
    )


def rarest_grams(words: DataFrame, cut: DataFrame, word: str, size: Column, small: bool) -> DataFrame:
    """``(word, _gram)``: of the grams of a word that which the fewest names have, ties by the
    gram. A word with a gram that no name has is in no name and is left out. ``cut`` are the
    :func:`grams` of the names; ``small`` words are not checked for hot grams."""
    own = grams(words, word, F.array(size))
    counts = cut.groupBy(F.col("_gram").alias("_of")).agg(F.count(F.lit(1)).alias("_names"))
    if small:
        known = own.join(counts, F.col("_gram") == F.col("_of"), "left")
    else:
        known = split_hot_keys(own, counts, {"_gram": "_of"})
    rarity = F.struct(F.coalesce("_names", F.lit(0).cast("bigint")).alias("names"), F.col("_gram").alias("gram"))
    rarest = known.groupBy(word).agg(F.min(rarity).alias("_rarest")).filter(F.col("_rarest.names") > 0)
    return rarest.select(word, F.col("_rarest.gram").alias("_key"))


def _pairs(words: DataFrame, names: DataFrame, word: str, name: str, small: bool) -> DataFrame:
    """``names`` with each of the distinct non-empty words that it contains.

    Names are cut into pieces of up to ``GRAM`` characters, so their number is bounded by the
    length of the names, whatever words there are. Each word is joined by the rarest of its own
    pieces, shorter words as a whole, and only the names that have that piece are searched for it.
    """
    size = F.least(F.length(word), F.lit(GRAM))
    sizes = words.agg(F.collect_set(size).alias("_sizes")).scalar()
    keyed = rarest_grams(words, grams(names.select(name), name, sizes), word, size, small)
    # Both sides are bare shuffles where they are not broadcast, so hot pieces are split at run time.
    found = grams(names, name, sizes).join(F.broadcast(keyed) if small else keyed, F.col("_gram") == F.col("_key"))
    return found.filter((F.col("_gram") == F.col(word)) | F.col(name).contains(F.col(word))).drop("_gram", "_key")


def containing(words: DataFrame, names: DataFrame, word: str, name: str) -> DataFrame:
    """Pairs ``(word, name)`` where the name contains the non-empty word."""
    wanted = _words(words, word)
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct()
    return _pairs(wanted, distinct, word, name, fits_broadcast(wanted)).select(word, name)


def first_containing(
    words: DataFrame, names: DataFrame, word: str, name: str, rank: str
) -> DataFrame:
    """For each non-empty word of a materialised table, the lowest ``rank`` among the
    names that contain it. Words in no name are left out.

    The ranks of a word are reduced in each task before they are shuffled, so that a word in
    most names costs no more than any other.
    """
    found = _pairs(_words(words, word), names.select(name, rank), word, name, fits_broadcast(words))
    return found.groupBy(word).agg(F.min(rank).alias(rank))


# Patterns in which a text need not stand as it is written: alternatives, inline flags, quoting,
# escapes that take further characters, nested classes.
_OPAQUE = r"\||\(\?|\\[QxuUc0pPkNX1-9]|\[[^\]]*\["
# What a pattern is cut at, in this order; a repeated character may be absent and goes along.
_CUTS = (
    r"\\.",  # escapes
    r"\[\^?\]?[^\]]*\]([?*+]|\{[^}]*\})*",  # classes
)
_GROUP = r"\([^()]*\)([?*+]|\{[^}]*\})*"
_REPEATS = r".([?*]|\{[^}]*\})[?+]?"
_DEPTH = 8


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a regular expression contains, null if none is found.

    Only what stands outside of groups and classes counts, so the text found may be shorter
    than it could be, but no match is without it.
    """
    rest = pattern
    for cut in _CUTS:
        rest = F.regexp_replace(rest, cut, "\n")
    for _ in range(_DEPTH):
        rest = F.regexp_replace(rest, _GROUP, "\n")
    rest = F.regexp_replace(rest, _REPEATS, "\n")
    runs = F.split(rest, r"[\n.^$+?*{}\[\]\\]+")
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("size"), run.alias("run"))))["run"]
    # A group left over is nested too deep, or not a group.
    plain = ~pattern.rlike(_OPAQUE) & ~pattern.contains("\n") & ~rest.rlike(r"[()]")
    return F.when(plain & (longest != ""), longest)


def matching_regex(patterns: DataFrame, names: DataFrame, pattern: str, name: str) -> DataFrame:
    """Pairs ``(pattern, name)`` where the regular expression is found in the name.

    Plain words, and words whose only special characters are round brackets
    around plain text (which match as if the brackets were absent), go through
    :func:`containing`. Of any other pattern the longest text that its matches must
    contain does, and only the names that have it are tested. Patterns without such a text, as
    alternatives, are tested against the distinct names in blocks joined by block number.
    """
    plain = r"^[^\\^$.|?*+()\[\]{}]*$"
    grouped = r"^([^\\^$.|?*+()\[\]{}]*\([^\\^$.|?*+()\[\]{}]*\))*[^\\^$.|?*+()\[\]{}]*$"
    wanted = patterns.select(pattern).filter(F.col(pattern).isNotNull()).distinct()
    is_word = F.col(pattern).rlike(plain) | F.col(pattern).rlike(grouped)
    keyed = materialise(
        wanted.select(
            pattern,
            is_word.alias("_whole"),
            F.when(is_word, F.regexp_replace(F.col(pattern), r"[()]", "")).otherwise(required_literal(F.col(pattern))).alias("_word"),
        )
    )
    indexed = keyed.filter(F.coalesce(F.col("_word"), F.lit("")) != "")
    fits = F.col("_whole") | F.expr(f"`{name}` rlike `{pattern}`")
    found = containing(indexed, names, "_word", name).join(indexed, "_word").filter(fits).select(pattern, name)
    others = keyed.filter(F.coalesce(F.col("_word"), F.lit("")) == "").select(pattern)
    if others.isEmpty():
        return found
    blocks = others.withColumn("_block", F.pmod(F.xxhash64(pattern), F.lit(REGEX_BLOCKS)))
    used = blocks.agg(F.collect_set("_block").alias("_b")).scalar()
    tested = (
        names.select(name).filter(F.col(name).isNotNull()).distinct()
        .withColumn("_used", used)
        .withColumn("_nblock", F.explode("_used"))
        .join(blocks, (F.col("_nblock") == F.col("_block")) & F.expr(f"`{name}` rlike `{pattern}`"))
        .select(pattern, name)
    )
    return found.unionByName(tested)
