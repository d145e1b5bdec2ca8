"""Insight columns of predictions and trends.

Predictions are taken flat: the published, rounded results together with the
inputs they used (``min_price``, ``max_price``, ``rainfall``, ``market``,
``variety``, ``grade``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.functions import texts as X
from cropline.functions.scalars import column, scale

PRICE = "predicted_price_inr_quintal"
REVENUE = "total_estimated_value_inr"
TONNES = "predicted_yield_tonnes"
TREND_KEY = ["State", "District", "Crop"]


def flatten(predictions: DataFrame) -> DataFrame:
    return predictions.select("*", "inputs_used.*").drop("inputs_used")


def confidence_bounds(predictions: DataFrame) -> DataFrame:
    """Twelve percent around price and revenue; the price does not go below zero."""
    bounds = {}
    for side, factor in (("low", X.BOUND_LOW), ("high", X.BOUND_HIGH)):
        bounds[f"price_{side}"] = F.greatest(F.lit(0.0), F.col(PRICE) * factor)
        bounds[f"revenue_{side}"] = F.col(REVENUE) * factor
    return predictions.withColumns(bounds)


def rainfall_class(z: Column | str) -> Column:
    z = column(z)
    return F.when(z < -X.RAIN_LIMIT, X.BELOW).when(z > X.RAIN_LIMIT, X.ABOVE).otherwise(X.NORMAL)


def _rain_z() -> Column:
    return scale("rainfall", "rainfall")


def fixed(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", column(c))


def plain_number(c: Column | str) -> Column:
    """Number as text without trailing zeros or exponent."""
    return F.regexp_replace(column(c).cast("decimal(28,10)").cast("string"), r"\.?0+$", "")


def used_area() -> Column:
    """Area of the request; nothing or zero counts as ten hectares."""
    area = F.nanvl(F.coalesce("area", F.lit(0.0)), F.lit(0.0))
    return F.when(area == 0, X.DEFAULT_AREA).otherwise(area)


def influence_weights(predictions: DataFrame) -> DataFrame:
    """Weights of area, rainfall and base in percent; they add up to 100."""

    def weight(parts: tuple, x: Column) -> Column:
        floor, most, factor = parts
        return F.floor(floor + F.least(F.lit(float(most)), x * factor) + 0.5).cast("int")

    area, rain = weight(X.AREA_WEIGHT, used_area()), weight(X.RAIN_WEIGHT, F.abs(_rain_z()))
    capped = area + rain >= X.WEIGHT_LIMIT
    df = predictions.withColumns(
        {
            "area_weight": F.when(capped, X.CAPPED_WEIGHTS[0]).otherwise(area),
            "rain_weight": F.when(capped, X.CAPPED_WEIGHTS[1]).otherwise(rain),
        }
    )
    return df.withColumn("base_weight", 100 - F.col("area_weight") - F.col("rain_weight"))


def influence_labels(weighted: DataFrame) -> DataFrame:
    """Words for the weights."""
    area, rain = F.col("area_weight"), F.col("rain_weight")
    return weighted.withColumns(
        {
            "area_influence": F.when(area > 65, X.VERY_HIGH).when(area < 45, X.MODERATE).otherwise(X.HIGH),
            "rain_influence": F.when(rain > 30, X.HIGH).when(rain < 15, X.LOW).otherwise(X.MEDIUM),
            "base_influence": F.lit(X.BASELINE),
        }
    )


def market_trend(predictions: DataFrame) -> DataFrame:
    """Predicted price against the middle of the given bounds."""
    diff = F.col(PRICE) - (F.col("min_price") + F.col("max_price")) / 2
    label = (
        F.when(diff > X.TREND_LIMIT, X.INCREASING)
        .when(diff < -X.TREND_LIMIT, X.DECREASING)
        .otherwise(X.STABLE)
    )
    return predictions.withColumn("market_trend", label)


def narratives(predictions: DataFrame, mode: str = "plain") -> DataFrame:
    """Rainfall sentence and explanation, ``plain`` or ``technical``."""
    mm = fixed("rainfall", 1)
    kind = rainfall_class(_rain_z())
    sentence = F.lit(None).cast("string")
    for label, text in X.RAIN_SENTENCES.items():
        sentence = F.when(kind == label, F.format_string(text, mm)).otherwise(sentence)
    area = plain_number(used_area())
    place = [F.col("crop"), F.col("district"), F.col("state")]
    df = influence_weights(predictions)
    if mode == "plain":
        explanation = F.format_string(X.PLAIN_EXPLANATION, area, mm, F.lower(kind), *place)
    else:
        weights = {c: F.col(f"{c}_weight").cast("string") for c in ("area", "rain", "base")}
        explanation = F.format_string(
            X.TECHNICAL_EXPLANATION,
            area, weights["area"], fixed(_rain_z(), 4), weights["rain"], *place, weights["base"],
        )
    return df.withColumns({"rainfall_narrative": sentence, "explanation": explanation}).drop(
        "area_weight", "rain_weight", "base_weight"
    )


def report_columns(predictions: DataFrame) -> DataFrame:
    """Predictions with all insight columns."""
    df = influence_labels(influence_weights(market_trend(confidence_bounds(predictions))))
    return df.withColumn("rainfall_class", rainfall_class(_rain_z()))


def valuation_report(predictions: DataFrame, mode: str = "plain") -> DataFrame:
    """The printed valuation as rows: request, position, attribute, value."""
    df = report_columns(predictions)
    rupee = F.lit("₹")
    z = {c: fixed(scale(c, c), 4) for c in ("rainfall", "min_price", "max_price")}
    mm = fixed("rainfall", 1)

    def money(c: str) -> Column:
        return F.concat(rupee, fixed(c, 2))

    def grouped(c: str) -> Column:
        return F.concat(rupee, F.format_number(F.col(c), 2))

    def shortest(c: str) -> Column:
        """Grouped with at most two decimals."""
        return F.regexp_replace(grouped(c), r"\.?0+$", "")

    def percent(c: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.lit("%"))

    def bound(c: str, side: str) -> Column:
        return F.concat(z[c], F.lit(f" (Raw {side}: ₹"), fixed(c, 2), F.lit(")"))

    values = [
        F.concat(fixed(TONNES, 2), F.lit(" Tonnes")),
        F.concat(money(PRICE), F.lit(" / Quintal")),
        grouped(REVENUE),
        F.concat(shortest("revenue_low"), F.lit(" to "), shortest("revenue_high")),
    ]
    place = ["state", "district", "crop", "season"]
    assumed = [F.col("grade"), F.col("market"), F.col("variety")]
    if mode == "plain":
        values += [F.col("area_influence"), F.col("rainfall_class"), F.col("base_influence"), F.col("market_trend")]
        values += [*map(F.col, place), F.concat(plain_number(used_area()), F.lit(" Hectares"))]
        values += [F.concat(mm, F.lit(" mm ("), F.col("rainfall_class"), F.lit(")")), *assumed]
        values += [F.concat(money("price_low"), F.lit(" – "), money("price_high"), F.lit(" per Quintal"))]
    else:
        values += [percent("area_weight"), percent("rain_weight"), percent("base_weight"), F.col("market_trend")]
        values += [*map(F.col, place), F.concat(plain_number(used_area()), F.lit(" Hectares"))]
        values += [F.concat(z["rainfall"], F.lit(" (Raw: "), mm, F.lit(" mm)")), *assumed]
        values += [bound("min_price", "Min"), bound("max_price", "Max")]
        if "latency_ms" in predictions.columns:
            values += [F.concat(plain_number("latency_ms"), F.lit(" ms"))]
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(a).alias("attribute"), v.alias("value"))
            for i, (a, v) in enumerate(zip(X.REPORT_ROWS[mode], values))
        ]
    )
    return df.select("req_id", F.inline(entries))


def normalise_series(trends: DataFrame) -> DataFrame:
    """Yield and price of each trend stretched to 0..1; a flat series stays at 0."""
    key = Window.partitionBy(*TREND_KEY)
    scaled = {}
    for c in ("yield", "price"):
        low, high = F.min(c).over(key), F.max(c).over(key)
        span = F.when(high == low, 1.0).otherwise(high - low)
        scaled[f"{c}_norm"] = (F.col(c) - low) / span
    return trends.withColumns(scaled)


def trend_endpoints(trends: DataFrame) -> DataFrame:
    """First and last point of each trend."""
    ends = []
    for side, pick, year in (("first", F.min_by, F.min), ("last", F.max_by, F.max)):
        ends.append(year("year").alias(f"{side}_year"))
        ends += [pick(c, "year").alias(f"{side}_{c}") for c in ("yield", "price")]
    return trends.groupBy(*TREND_KEY).agg(*ends)
