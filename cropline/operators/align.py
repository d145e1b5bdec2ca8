"""Aligning market prices and rainfall with raw crop production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cropline import schemas
from cropline.functions import constants as K
from cropline.functions.joins import lookup
from cropline.functions.matching import containing, matching_regex
from cropline.functions.scalars import exact_mean, lower_key, not_nan, scale, strip, upper_key
from cropline.operators.aggregates import PRICE_COLUMNS, price_means
from cropline.operators.clean import only_state
from cropline.session import materialise


def _map_literal(entries: dict[str, str | list[str]]) -> Column:
    pairs: list[Column] = []
    for key, value in entries.items():
        items = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        pairs += [F.lit(key), items]
    return F.create_map(*pairs)


def expand_aliases(
    df: DataFrame, aliases: dict[str, list[str]] = K.CROP_ALIASES, crop: str = "Crop"
) -> DataFrame:
    """One row per commodity that may price the crop, with its ``priority``; a crop
    without aliases stands for itself."""
    name = F.lower(crop)
    known = F.try_element_at(_map_literal(aliases), name)
    return df.select("*", F.posexplode(F.coalesce(known, F.array(name))).alias("priority", "alias"))


def price_fallback(
    targets: DataFrame,
    means: DataFrame,
    aliases: dict[str, list[str]] = K.CROP_ALIASES,
    literal: bool = False,
) -> DataFrame:
    """Prices of each distinct (District, Year, Crop) of ``targets``.

    Levels: same district and year, same year, any year, constants. The first
    level with a matching commodity decides, even if its mean is null; inside a
    level the first alias, then the first commodity by name. Which names match
    which aliases is settled once on the distinct names, everything after that
    is an equi-join. ``means`` comes from :func:`price_means` and is read
    several times: it should be stored or materialised.
    """
    wanted = expand_aliases(targets.select("District", "Year", "Crop").distinct(), aliases)
    wanted = materialise(wanted)
    match = containing if literal else matching_regex
    pairs = materialise(match(wanted, means, "alias", "Commodity"))

    prices = F.struct(*PRICE_COLUMNS)
    df = wanted
    for level, grain in enumerate((["District", "Year"], ["Year"], []), 1):
        best = (
            means.filter(F.col("level") == level)
            .join(pairs, "Commodity")
            .groupBy(*grain, "alias")
            .agg(F.min_by(prices, "Commodity").alias(f"_prices{level}"))
        )
        df = df.join(best, [*grain, "alias"], "left")
    ranked = []
    for level in (1, 2, 3):
        hit = F.col(f"_prices{level}")
        option = F.struct("priority", F.lit(level).alias("level"), hit.alias("prices"))
        ranked.append(F.min(F.when(hit.isNotNull(), option)).alias(f"_l{level}"))
    constant = F.struct(
        F.lit(0).alias("priority"),
        F.lit(4).alias("level"),
        F.struct(
            F.lit(K.DEFAULT_PRICES["min"]).alias("Min_Price"),
            F.lit(K.DEFAULT_PRICES["max"]).alias("Max_Price"),
            F.lit(K.DEFAULT_PRICES["modal"]).alias("Modal_Price"),
        ).alias("prices"),
    )
    chosen = df.groupBy("District", "Year", "Crop").agg(*ranked).withColumn(
        "_chosen", F.coalesce("_l1", "_l2", "_l3", constant)
    )
    return chosen.select(
        "District", "Year", "Crop", F.col("_chosen.level").alias("level"), "_chosen.prices.*"
    )


def season_rain(rain: DataFrame) -> DataFrame:
    """Seasonal rainfall of one subdivision in long form: year, column, millimetres.

    A year that occurs twice is an error.
    """
    long = rain.unpivot(["YEAR"], K.SEASON_TOTALS, "rain_column", "mm")
    problem = F.raise_error(F.lit("rainfall has a year twice")).cast("double")
    return long.groupBy("YEAR", "rain_column").agg(
        F.when(F.count(F.lit(1)) > 1, problem).otherwise(F.max(not_nan("mm"))).alias("mm")
    )


def rain_means(rain: DataFrame) -> DataFrame:
    """Mean of each seasonal rainfall column over all years."""
    return season_rain(rain).groupBy("rain_column").agg(exact_mean("mm").alias("mean_mm"))


def rainfall_for(targets: DataFrame, rain: DataFrame) -> DataFrame:
    """Add ``rain_column`` and ``rain_mm``, the rainfall of the season in its year,
    or over all years where that is missing."""
    long = materialise(season_rain(rain))
    means = long.groupBy("rain_column").agg(exact_mean("mm").alias("_mean"))
    column = F.coalesce(F.try_element_at(_map_literal(K.SEASON_RAIN), F.col("Season")), F.lit(K.ANY_SEASON_RAIN))
    df = targets.withColumn("rain_column", column)
    df = lookup(df, long.withColumnRenamed("mm", "_mm"), {"Year": "YEAR", "rain_column": "rain_column"})
    df = lookup(df, means, {"rain_column": "rain_column"})
    return df.withColumn("rain_mm", F.coalesce("_mm", "_mean")).drop("_mm", "_mean")


def align_state(
    production: DataFrame,
    prices: DataFrame,
    rain: DataFrame,
    state: str,
    subdivision: str,
    aliases: dict[str, list[str]] = K.CROP_ALIASES,
) -> DataFrame:
    """Fact rows of one state from raw production, prices and rainfall."""
    facts = only_state(production, state, "State_Name").select(
        F.lit(state).alias("State"),
        upper_key("District_Name").alias("District"),
        F.col("Crop_Year").cast("int").alias("Year"),
        strip("Season").alias("Season"),
        strip("Crop").alias("Crop"),
        "Area",
        "Production",
        F.lit(subdivision).alias("SUBDIVISION"),
    )
    local = only_state(prices, state).withColumns(
        {"District": upper_key("District"), "Commodity": lower_key("Commodity")}
    )
    means = materialise(price_means(local))
    resolved = materialise(price_fallback(facts, means, aliases)).drop("level")
    key = {k: k for k in ("District", "Year", "Crop")}
    df = lookup(rainfall_for(facts, rain.filter(upper_key("SUBDIVISION") == subdivision)), resolved, key)
    return df.withColumns(
        {
            "Rainfall": scale("rain_mm", "rainfall"),
            "Min_Price": scale("Min_Price", "min_price"),
            "Max_Price": scale("Max_Price", "max_price"),
        }
    ).select(*schemas.AGRI.names)


def replace_state(base: DataFrame, new: DataFrame, state: str) -> DataFrame:
    """Rows of one state replaced. Compared ignoring case but not blanks; rows
    without a state stay, columns missing on one side become null."""
    kept = base.filter(~F.upper("State").eqNullSafe(state))
    return kept.unionByName(new, allowMissingColumns=True)
