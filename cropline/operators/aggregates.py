"""Group aggregates: metadata, defaults, trends and price means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions import constants as K
from cropline.functions.joins import lookup
from cropline.functions.ranking import ordinals
from cropline.functions.scalars import (
    add_sums,
    clamp,
    exact_mean,
    exact_sum,
    not_nan,
    order_bounds,
    round_even,
    round_mean,
    strip,
    sum_value,
    unscale,
    upper_key,
)
from cropline.operators.clean import drop_nulls, filter_contains, yield_per_area
from cropline.operators.matching import match_contains, preferred
from cropline.session import derived

KEY = ["State", "District", "Crop"]
PRICE_COLUMNS = ["Min_Price", "Max_Price", "Modal_Price"]


def state_districts(agri: DataFrame) -> DataFrame:
    """Sorted districts of each state."""
    pairs = agri.select("State", "District").distinct()
    return pairs.groupBy("State").agg(F.sort_array(F.collect_list("District")).alias("districts"))


def district_crops(agri: DataFrame) -> DataFrame:
    """Sorted crops of each district."""
    triples = agri.select(*KEY).distinct()
    return triples.groupBy("State", "District").agg(F.sort_array(F.collect_list("Crop")).alias("crops"))


def explode_list(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per list entry, with its 0-based ``ordinal``."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode(array).alias("ordinal", name))


def category_values(df: DataFrame, features: dict[str, str], model: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of each category, in each group of ``by``; ``features`` maps a
    feature to its column. All features come from one scan."""
    values = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(c).cast("string").alias("value"))
                    for f, c in features.items()
                ]
            )
        ).alias("v")
    ).select(F.lit(model).alias("model"), "v.feature", "v.value", *by)
    return values.filter(F.col("value").isNotNull()).distinct()


def vocabulary(values: DataFrame) -> DataFrame:
    """Values of :func:`category_values`, of one or more models, with their 0-based
    code in sorted order."""
    return ordinals(values, ["model", "feature"], ["value"]).select("model", "feature", "ordinal", "value")


def metadata(agri: DataFrame, vocab: DataFrame) -> DataFrame:
    """Regions, crops by region and both vocabularies as one long table."""
    regions = explode_list(state_districts(agri), "districts", "value").select(
        F.lit("regions").alias("kind"), F.col("State").alias("key"), "ordinal", "value"
    )
    crops = explode_list(district_crops(agri), "crops", "value").select(
        F.lit("region_crops").alias("kind"),
        F.concat_ws("|", "State", "District").alias("key"),
        "ordinal",
        "value",
    )
    entries = vocab.select(
        F.col("model").alias("kind"), F.col("feature").alias("key"), "ordinal", "value"
    )
    return regions.unionByName(crops).unionByName(entries)


DEFAULT_COLUMNS = {"rainfall": "Rainfall", "min_price": "Min_Price", "max_price": "Max_Price"}


def crop_defaults(agri: DataFrame) -> DataFrame:
    """Mean scaled rainfall and prices of each (state, district, crop)."""
    return agri.groupBy(*KEY).agg(*[round_even(exact_mean(c), 4).alias(n) for n, c in DEFAULT_COLUMNS.items()])


def _trend_rows(agri: DataFrame) -> DataFrame:
    return agri.filter("trend_ok") if "trend_ok" in agri.columns else agri


def crop_trends(agri: DataFrame) -> DataFrame:
    """Mean yield and price of each (state, district, crop) and year."""
    return (
        _trend_rows(agri)
        .groupBy(*KEY, F.col("Year").alias("year"))
        .agg(
            round_mean(exact_mean(yield_per_area("Production", "Area")), 4).alias("yield"),
            round_even(exact_mean("Modal_Price"), 2).alias("price"),
        )
    )


def nest_trends(trends: DataFrame) -> DataFrame:
    """One row per key with its trend as an array by year; a key has few years."""
    return trends.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("year", "yield", "price"))).alias("historical_trend")
    )


def yearly_rollup(agri: DataFrame) -> DataFrame:
    """Sums by (state, district, crop, year), from which :func:`rollup_defaults`
    and :func:`rollup_trends` derive, so that the facts are shuffled once."""
    ok = F.col("trend_ok") if "trend_ok" in agri.columns else F.lit(True)
    exact = {"yield": yield_per_area("Production", "Area"), "price": F.col("Modal_Price")}
    sums = []
    for name, value in exact.items():
        value = F.when(ok, not_nan(value))
        sums += [exact_sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]
    for name, c in DEFAULT_COLUMNS.items():
        sums += [exact_sum(c).alias(f"{name}_sum"), F.count(not_nan(c)).alias(f"{name}_n")]
    return agri.groupBy(*KEY, "Year").agg(*sums, F.count_if(ok).alias("trend_rows"))


def rollup_defaults(yearly: DataFrame) -> DataFrame:
    return yearly.groupBy(*KEY).agg(
        *[
            round_even(F.try_divide(sum_value(add_sums(f"{c}_sum")), F.sum(f"{c}_n")), 4).alias(c)
            for c in DEFAULT_COLUMNS
        ]
    )


def rollup_trends(yearly: DataFrame) -> DataFrame:
    def mean(name: str) -> Column:
        return F.try_divide(sum_value(f"{name}_sum"), F.col(f"{name}_n"))

    return yearly.filter("trend_rows > 0").select(
        *KEY,
        F.col("Year").alias("year"),
        round_mean(mean("yield"), 4).alias("yield"),
        round_even(mean("price"), 2).alias("price"),
    )


def defaults_with_fallback(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """Scaled defaults of each requested key.

    An unknown key gets the mean over the known keys that share its state or its
    crop, each key counting once. Sums by state, by crop and by both replace the
    "or" (inclusion and exclusion); they are computed once for ``defaults``, which should
    be stored or materialised.
    """
    features = list(K.DEFAULT_SCALED)
    exact = defaults.select(
        *KEY, *[F.col(c).alias(f"_exact_{c}") for c in features], F.lit(True).alias("_known")
    )
    df = lookup(requests, exact, dict(zip(("state", "district", "crop"), KEY)), source=defaults)
    groups = {
        "state": {"state": "State"},
        "crop": {"crop": "Crop"},
        "both": {"state": "State", "crop": "Crop"},
    }
    for name, on in groups.items():

        def sums(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*on.values()).agg(
                F.count(F.lit(1)).alias(f"_n_{name}"),
                *[exact_sum(c).alias(f"_{name}_{c}") for c in features],
            )

        df = lookup(df, derived(defaults, f"sums by {name}", sums), on, source=defaults)

    def either(prefix: str, suffix: str = "") -> Column:
        a, b, both = (F.coalesce(F.col(f"_{prefix}{g}{suffix}"), F.lit(0)) for g in groups)
        return a + b - both

    n = either("n_")
    filled = {}
    for c in features:
        exact, rest = either("", f"_{c}.exact"), either("", f"_{c}.rest")
        mean = round_even(F.try_divide(exact.cast("double") + rest, n), 4)
        filled[c] = F.when(F.col("_known"), F.col(f"_exact_{c}")).otherwise(
            F.when(n > 0, mean).otherwise(K.DEFAULT_SCALED[c])
        )
    helpers = ["_known", *[f"_exact_{c}" for c in features], *[f"_n_{g}" for g in groups]]
    helpers += [f"_{g}_{c}" for g in groups for c in features]
    return df.withColumns(filled).drop(*helpers)


def region_defaults(requests: DataFrame, defaults: DataFrame, vocab: DataFrame) -> DataFrame:
    """Physical default inputs and default market, variety and grade of each key.

    Keys are looked up as they are, without folding case.
    """
    df = defaults_with_fallback(requests, defaults)
    low, high = order_bounds(unscale("min_price", "min_price"), unscale("max_price", "max_price"))
    df = df.withColumns(
        {
            "rainfall": round_even(unscale("rainfall", "rainfall"), 1),
            "min_price": round_even(low, 2),
            "max_price": round_even(high, 2),
        }
    )
    df = match_contains(df, vocab, "district", "market", "default_market")
    df = match_contains(df, vocab, "crop", "variety", "default_variety", K.GENERIC_VARIETY)
    return df.withColumn("default_grade", preferred(vocab, "grade", K.PREFERRED_GRADE))


def price_means(prices: DataFrame) -> DataFrame:
    """Mean prices by (district, year, commodity), (year, commodity) and commodity.

    The rows are first summed at the finest grain; only those sums are expanded
    into the three grains. A grain leaves out rows in which one of its own keys
    is missing.
    """
    keys = ["District", "Year", "Commodity"]
    sums = prices.groupBy(*keys).agg(
        *[exact_sum(c).alias(f"s_{c}") for c in PRICE_COLUMNS],
        *[F.count(not_nan(c)).alias(f"n_{c}") for c in PRICE_COLUMNS],
    )
    district, year, commodity = (F.col(k) for k in keys)
    grains = sums.groupingSets([keys, ["Year", "Commodity"], ["Commodity"]], *keys).agg(
        F.grouping_id().alias("_grain"),
        *[
            F.try_divide(sum_value(add_sums(f"s_{c}")), F.sum(f"n_{c}")).alias(c)
            for c in PRICE_COLUMNS
        ],
    )
    complete = (
        commodity.isNotNull()
        & ((F.col("_grain") >= 6) | year.isNotNull())
        & ((F.col("_grain") >= 4) | district.isNotNull())
    )
    level = F.when(F.col("_grain") == 0, 1).when(F.col("_grain") == 4, 2).otherwise(3)
    return grains.filter(complete).select(level.alias("level"), *keys, *PRICE_COLUMNS)


def price_means_by_district(prices: DataFrame) -> DataFrame:
    """Mean min and max price by state, district and year."""
    keys = ["State", "District", "Year"]
    clean = prices.withColumns({"State": upper_key("State"), "District": upper_key("District")})
    return (
        drop_nulls(clean, keys)
        .groupBy(*keys)
        .agg(exact_mean("Min_Price").alias("Min_Price"), exact_mean("Max_Price").alias("Max_Price"))
    )


def commodity_averages(prices: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Mean prices of each commodity inside a region."""
    region = drop_nulls(filter_contains(prices, filters), ["Commodity"])
    return region.groupBy("Commodity").agg(*[exact_mean(c).alias(c) for c in PRICE_COLUMNS])


def region_averages(prices: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Mean prices of a region, by year."""
    region = filter_contains(prices, filters)
    return region.groupBy("Year").agg(*[exact_mean(c).alias(c) for c in PRICE_COLUMNS])


def fallback_yield(
    requests: DataFrame, trends: DataFrame, states: tuple[str, ...] | None = None
) -> DataFrame:
    """Yield from history: the mean over the years of the key, else of the state
    and crop, else of the crop, else a constant; times area, not below zero.

    Adds ``avg_yield_ha``, ``yield_level`` (1 to 4) and ``predicted_yield``; the
    three are null outside ``states``, if given. The means are computed once for ``trends``,
    which should be stored or materialised.
    """
    levels = [["State", "District", "Crop"], ["State", "Crop"], ["Crop"]]
    sides = {"State": "_state", "District": "_district", "Crop": "crop"}
    df = requests.withColumns({"_state": upper_key("state"), "_district": upper_key("district")})
    for i, keys in enumerate(levels):

        def means(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*keys).agg(exact_mean("yield").alias(f"_yield{i}"))

        df = lookup(df, derived(trends, f"yields by {' '.join(keys)}", means), {sides[k]: k for k in keys}, source=trends)
    found = [F.col(f"_yield{i}") for i in range(len(levels))]
    level = F.lit(len(levels) + 1)
    for i in reversed(range(len(levels))):
        level = F.when(found[i].isNotNull(), i + 1).otherwise(level)
    mean = F.coalesce(*found, F.lit(K.DEFAULT_YIELD))
    applies = F.col("_state").isin(*states) if states is not None else F.lit(True)
    return df.withColumns(
        {
            "avg_yield_ha": F.when(applies, mean),
            "yield_level": F.when(applies, level),
            "predicted_yield": F.when(applies, clamp(mean * F.col("area"))),
        }
    ).drop("_state", "_district", *[f"_yield{i}" for i in range(len(levels))])


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def season_of(df: DataFrame) -> DataFrame:
    return df.withColumn("Season", strip("Season"))
