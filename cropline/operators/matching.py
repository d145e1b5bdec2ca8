"""Matching request fields to vocabulary entries. A vocabulary is read many times
and should be stored or materialised."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions.joins import fits_broadcast, lookup
from cropline.functions.matching import first_containing
from cropline.functions.scalars import lower_key, strip
from cropline.session import derived, materialise


def _entries(vocab: DataFrame, feature: str) -> DataFrame:
    return vocab.filter(F.col("feature") == feature)


def _firsts(vocab: DataFrame) -> DataFrame:
    """First entry of every feature, few as they are, as one map."""
    entry = F.min(F.struct(F.col("ordinal").alias("o"), F.col("value").alias("v"))).alias("first")
    firsts = vocab.groupBy("feature").agg(entry)
    return firsts.agg(F.map_from_entries(F.collect_list(F.struct("feature", "first"))).alias("m"))


def _first(vocab: DataFrame, feature: str) -> tuple[Column, Column]:
    """Value and code of the first entry: the same subquery for every feature, so that it
    runs once in a plan."""
    one = derived(vocab, "firsts", _firsts).scalar()
    return one[F.lit(feature)]["v"], one[F.lit(feature)]["o"]


def _folded_names(vocab: DataFrame) -> DataFrame:
    """First entry of each name, names compared without case and outer blanks."""
    return vocab.groupBy("feature", lower_key("value").alias("_name")).agg(
        F.min("ordinal").alias("_ordinal"), F.min_by("value", "ordinal").alias("_value")
    )


_by_feature: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()


def _by_folded_name(vocab: DataFrame, feature: str) -> DataFrame:
    """Names of one feature, the same table at every call: it is counted once."""
    names = derived(vocab, "names", _folded_names)
    known = _by_feature.setdefault(names, {})
    if feature not in known:
        known[feature] = names.filter(F.col("feature") == feature).drop("feature")
    return known[feature]


def match_category(
    requests: DataFrame, vocab: DataFrame, name: str, feature: str | None = None, out: str | None = None
) -> DataFrame:
    """First vocabulary entry equal to a field apart from case and outer blanks,
    else the first entry of all. Adds ``<out>_value`` and ``<out>_code``."""
    feature, out = feature or name, out or name
    # One large feature does not make the joins with the others shuffles.
    names = _by_folded_name(vocab, feature)
    df = lookup(requests.withColumn("_field", lower_key(name)), names, {"_field": "_name"}, chained=True)
    value, ordinal = _first(vocab, feature)
    return df.withColumns(
        {
            f"{out}_value": F.coalesce(F.col("_value"), value),
            f"{out}_code": F.coalesce(F.col("_ordinal"), ordinal),
        }
    ).drop("_field", "_value", "_ordinal")


def match_either(
    requests: DataFrame, vocab: DataFrame, a: str, b: str, feature: str, out: str
) -> DataFrame:
    """First vocabulary entry equal to either field, whichever comes first in the
    vocabulary. Two joins instead of an "or"."""
    names = _by_folded_name(vocab, feature)
    df = requests
    for i, name in enumerate((a, b)):
        side = names.select("_name", F.struct("_ordinal", "_value").alias(f"_hit{i}"))
        df = lookup(df.withColumn("_field", lower_key(name)), side, {"_field": "_name"}, source=names, chained=True)
        df = df.drop("_field")
    value, ordinal = _first(vocab, feature)
    hit = F.least("_hit0", "_hit1")
    return df.withColumns(
        {
            f"{out}_value": F.coalesce(hit["_value"], value),
            f"{out}_code": F.coalesce(hit["_ordinal"], ordinal),
        }
    ).drop("_hit0", "_hit1")


def match_contains(
    requests: DataFrame, vocab: DataFrame, name: str, feature: str, out: str, extra: str | None = None
) -> DataFrame:
    """First vocabulary entry that contains a field, or the word ``extra``, without
    regard to case; else the first entry. An empty field matches the first entry."""
    entries = _entries(vocab, feature).withColumn("_name", F.lower("value"))
    words = materialise(requests.select(F.lower(name).alias("_word")).distinct())
    values = entries.select(F.col("ordinal").alias("_ordinal"), F.col("value").alias("_value"))
    hits = (
        first_containing(words, entries, "_word", "_name", "ordinal")
        .join(values, F.col("ordinal") == F.col("_ordinal"))
        .select("_word", F.struct("_ordinal", "_value").alias("_hit"))
    )
    df = lookup(requests.withColumn("_field", F.lower(name)), hits, {"_field": "_word"}, source=words, chained=True)
    value, _ = _first(vocab, feature)
    hit = F.when(F.col("_field") != "", F.col("_hit"))
    if extra is not None:
        generic = (
            entries.filter(F.col("_name").contains(extra.lower()))
            .agg(F.min(F.struct(F.col("ordinal").alias("_ordinal"), F.col("value").alias("_value"))).alias("g"))
            .scalar()
        )
        hit = F.when(F.col("_field") != "", F.least("_hit", generic))
    return df.withColumn(out, F.coalesce(hit["_value"], value)).drop("_field", "_hit")


def preferred(vocab: DataFrame, feature: str, value: str) -> Column:
    """``value`` if the vocabulary has it, else the first entry."""
    rank = F.struct((F.col("value") != value).alias("other"), "ordinal")
    return _entries(vocab, feature).agg(F.min_by("value", rank).alias("v")).scalar()


def encode(
    requests: DataFrame, vocab: DataFrame, features: dict[str, str]
) -> DataFrame:
    """Add the vocabulary code of each field; ``features`` maps a field to its feature."""
    # Features that are too large to broadcast come last, when the texts of the others are
    # codes: fewer bytes are shuffled.
    for name in sorted(features, key=lambda name: not fits_broadcast(_by_folded_name(vocab, features[name]))):
        requests = match_category(requests, vocab, name, features[name])
    return requests


def regions(meta: DataFrame, state: str | None = None, district: str | None = None) -> DataFrame:
    """Entries of the next selector: states, districts of a state, crops of a district."""
    if state is None:
        states = meta.filter(F.col("kind") == "regions").select(F.col("key").alias("value")).distinct()
        return states.orderBy("value")
    if district is None:
        chosen = meta.filter((F.col("kind") == "regions") & (F.col("key") == state))
    else:
        chosen = meta.filter((F.col("kind") == "region_crops") & (F.col("key") == f"{state}|{district}"))
    return chosen.select("value").orderBy("value")


def selector_values(meta: DataFrame) -> DataFrame:
    """Season names as a selector shows them."""
    seasons = meta.filter((F.col("kind") == "production") & (F.col("key") == "season"))
    return seasons.select(strip("value").alias("value"), "ordinal").orderBy("ordinal")
