"""Projections, filters, parsing and validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions import constants as K
from cropline.functions.joins import lookup
from cropline.functions.scalars import (
    clamp,
    column,
    lower_key,
    parse_double,
    parse_int,
    safe_ratio,
    scale,
    strip,
    swapped,
    unscale,
    upper_key,
)


def normalise(df: DataFrame, upper: list[str] = [], lower: list[str] = [], plain: list[str] = []) -> DataFrame:
    """Strip text columns, and fold the case of those in ``upper`` and ``lower``."""
    changes = {c: upper_key(c) for c in upper}
    changes |= {c: lower_key(c) for c in lower}
    changes |= {c: strip(c) for c in plain}
    return df.withColumns(changes)


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers where the text holds one, else null (NaN counts as missing)."""
    parsed = {c: parse_double(c) for c in cols}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in parsed.items()})


def drop_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows complete in all of ``cols``; NaN counts as missing."""
    floating = [c for c, kind in df.dtypes if c in cols and kind in ("double", "float")]
    kept = df.na.drop(how="any", subset=cols)
    for c in floating:
        kept = kept.filter(~F.isnan(c))
    return kept


def only_state(df: DataFrame, state: str, state_column: str = "State") -> DataFrame:
    return df.filter(upper_key(state_column) == state)


def filter_contains(df: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows in which every column contains its needle, ignoring case."""
    for c, needle in needles.items():
        df = df.filter(F.upper(c).contains(needle.upper()))
    return df


def yield_per_area(production: Column | str, area: Column | str) -> Column:
    return safe_ratio(production, area)


def parse_agri(raw: DataFrame) -> DataFrame:
    """Typed fact rows plus ``trend_ok``.

    A row with an unreadable area, production, modal price or year stays in the
    table for defaults but is left out of trends. Unreadable rainfall or scaled
    prices are an error.
    """
    strict = [c for c in ("Rainfall", "Min_Price", "Max_Price") if c in raw.columns]
    soft = ["Area", "Production", "Modal_Price"]
    bad = F.raise_error(F.lit("unreadable number in a required column")).cast("double")
    changes = {c: F.coalesce(parse_double(c), bad) for c in strict}
    changes |= {c: parse_double(c) for c in soft}
    changes["Year"] = parse_int("Year")
    # The strict columns are part of the flag, so that their check runs wherever
    # the rows are used, also where the columns themselves are pruned.
    readable = F.lit(True)
    for c in [*strict, *soft, "Year"]:
        readable = readable & F.col(c).isNotNull()
    return raw.withColumns(changes).withColumn("trend_ok", readable)


def scale_columns(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Replace raw columns by z-scores; ``features`` maps a column to its feature."""
    return df.withColumns({c: scale(c, f) for c, f in features.items()})


def unscale_columns(df: DataFrame, features: dict[str, str]) -> DataFrame:
    return df.withColumns({c: unscale(c, f) for c, f in features.items()})


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def _number(df: DataFrame, name: str, whole: bool = False) -> Column:
    if _is_text(df, name):
        return parse_int(name) if whole else parse_double(name)
    return column(name).cast("int" if whole else "double")


def _absent(df: DataFrame, name: str) -> Column:
    """A field counts as absent by its ``has_`` flag, or without one if it is null."""
    if name not in df.columns:
        return F.lit(True)
    flag = f"has_{name}"
    return ~F.col(flag) if flag in df.columns else F.col(name).isNull()


def _or_default(df: DataFrame, name: str, default: float | int) -> Column:
    if name not in df.columns:
        return F.lit(default)
    value = F.lit(str(default)) if _is_text(df, name) else F.lit(default)
    return F.when(_absent(df, name), value).otherwise(F.col(name))


def normalise_requests(requests: DataFrame, as_of: date) -> DataFrame:
    """Requests with every field present: state and district upper-cased, the
    commodity defaulting to the crop, area to 1, year and month to ``as_of``."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in requests.columns else F.lit("")

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in requests.columns else F.lit(None).cast(kind)

    commodity = F.coalesce(optional("commodity", "string"), text("crop"))
    return requests.withColumns(
        {
            "state": F.upper(text("state")),
            "district": F.upper(text("district")),
            "crop": text("crop"),
            "season": text("season"),
            "commodity": commodity,
            "market": optional("market", "string"),
            "variety": optional("variety", "string"),
            "grade": optional("grade", "string"),
            "area": _or_default(requests, "area", 1.0),
            "year": _or_default(requests, "year", as_of.year),
            "month": _or_default(requests, "month", as_of.month),
            "has_rainfall": ~_absent(requests, "rainfall"),
            "rainfall": optional("rainfall", "double"),
            "min_price": optional("min_price", "double"),
            "max_price": optional("max_price", "double"),
        }
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Normalised requests with numeric fields and a ``reason``, null if valid."""
    area, rainfall = _number(requests, "area"), _number(requests, "rainfall")
    year, month = _number(requests, "year", True), _number(requests, "month", True)
    prices = {c: _number(requests, c) for c in ("min_price", "max_price")}
    bad_price = F.lit(False)
    for c, value in prices.items():
        bad_price = bad_price | (F.col(c).isNotNull() & value.isNull())
    reason = (
        F.when(area.isNull(), K.BAD_AREA)
        .when(year.isNull() | month.isNull(), K.BAD_DATE)
        .when(F.col("has_rainfall") & rainfall.isNull(), K.BAD_RAINFALL)
        .when(bad_price, K.BAD_PRICE)
    )
    return requests.withColumns(
        {"reason": reason, "area": area, "year": year, "month": month, "rainfall": rainfall, **prices}
    )


def resolve_inputs(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """Raw and scaled rainfall and prices of each request, and ``has_history``.

    A given value is clamped and then scaled. A default is scaled already: its
    raw value is clamped, the scaled one is not recomputed. Bounds in the wrong
    order are exchanged raw and scaled, although the two scales differ.
    """
    known = defaults.select(
        "State", "District", "Crop",
        *[F.col(c).alias(f"_d_{c}") for c in K.SCALING],
        F.lit(True).alias("_known"),
    )
    key = {"state": "State", "district": "District", "crop": "Crop"}
    df = lookup(requests, known, key, source=defaults)
    matched = F.coalesce(F.col("_known"), F.lit(False))
    base = {c: F.when(matched, F.col(f"_d_{c}")).otherwise(v) for c, v in K.DEFAULT_SCALED.items()}
    given = F.col("has_rainfall")
    df = df.withColumns(
        {
            "rainfall_raw": F.when(given, F.col("rainfall")).otherwise(unscale(base["rainfall"], "rainfall")),
            "rainfall_scaled": F.when(given, scale("rainfall", "rainfall")).otherwise(base["rainfall"]),
        }
    )
    for c in ("min_price", "max_price"):
        has = F.col(c).isNotNull()
        df = df.withColumns(
            {
                f"_raw_{c}": clamp(F.when(has, F.col(c)).otherwise(unscale(base[c], c))),
                f"_scaled_{c}": F.when(has, scale(clamp(c), c)).otherwise(base[c]),
            }
        )
    swap = swapped(F.col("_raw_min_price"), F.col("_raw_max_price"))
    pairs = {}
    for kind in ("raw", "scaled"):
        low, high = F.col(f"_{kind}_min_price"), F.col(f"_{kind}_max_price")
        pairs[f"min_price_{kind}"] = F.when(swap, high).otherwise(low)
        pairs[f"max_price_{kind}"] = F.when(swap, low).otherwise(high)
    return (
        df.withColumns({**pairs, "has_history": matched})
        .drop("_known", *[f"_d_{c}" for c in K.SCALING])
        .drop(*[f"_{kind}_{c}" for kind in ("raw", "scaled") for c in ("min_price", "max_price")])
    )


def standardise(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Z-score of a column by its own mean and sample standard deviation."""
    moments = df.agg(F.struct(F.avg(name).alias("m"), F.stddev_samp(name).alias("s")).alias("x")).scalar()
    return df.withColumn(out or name, F.try_divide(F.col(name) - moments["m"], moments["s"]))
