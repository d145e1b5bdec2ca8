"""Yield and price scoring, valuation and outcome rows."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions import constants as K
from cropline.functions.joins import lookup
from cropline.functions.scalars import clamp, round_even, safe_ratio, scale
from cropline.operators.aggregates import nest_trends
from cropline.operators.matching import encode
from cropline.session import derived, materialise

REQUEST_KEY = {"state": "State", "district": "District", "crop": "Crop"}
YIELD_CATEGORIES = {"State": "state", "Crop": "crop", "Season": "season"}
PRICE_CATEGORIES = {
    "State": "state",
    "District": "district",
    "Market": "market",
    "Commodity": "commodity",
    "Variety": "variety",
    "Grade": "grade",
}
# Order of the model inputs.
YIELD_FEATURES = ["state_code", "crop_code", "season_code", "area", "rainfall_scaled"]
PRICE_FEATURES = [
    "state_code",
    "district_code",
    "market_code",
    "commodity_code",
    "variety_code",
    "grade_code",
    "year",
    "month",
    "min_price_scaled",
    "max_price_scaled",
]


def _features(df: DataFrame, names: list[str]) -> DataFrame:
    numeric = df.withColumns({f"_f_{n}": F.col(n).cast("double") for n in names})
    assembler = VectorAssembler(
        inputCols=[f"_f_{n}" for n in names], outputCol="features", handleInvalid="keep"
    )
    return assembler.transform(numeric).drop(*[f"_f_{n}" for n in names])


def _encoded(df: DataFrame, vocab: DataFrame, categories: dict[str, str]) -> DataFrame:
    renamed = df.withColumnsRenamed({c: f for c, f in categories.items() if c in df.columns})
    return encode(renamed, vocab, {f: f for f in categories.values()})


def _fit(df: DataFrame, names: list[str], label: str, seed: int, stored: bool, **options) -> Model:
    trainer = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", seed=seed, **options
    )
    complete = _features(df.na.drop(subset=[*names, label]), names).select("features", label)
    # The trainer reads its input several times; its rows are joined only once.
    return trainer.fit(complete if stored else materialise(complete))


def yield_training_rows(agri: DataFrame, vocab: DataFrame) -> DataFrame:
    rows = agri.withColumnsRenamed({"Area": "area", "Rainfall": "rainfall_scaled"})
    return _encoded(rows, vocab, YIELD_CATEGORIES)


def price_training_rows(prices: DataFrame, vocab: DataFrame) -> DataFrame:
    rows = prices.withColumns(
        {"min_price_scaled": scale("Min_Price", "min_price"), "max_price_scaled": scale("Max_Price", "max_price")}
    )
    return _encoded(rows, vocab, PRICE_CATEGORIES)


def fit_yield(agri: DataFrame, vocab: DataFrame | None, seed: int = 7, **options) -> Model:
    """Boosted trees for total production from coded state, crop and season, area
    and scaled rainfall. Codes are plain numbers to the trees. Without a vocabulary
    ``agri`` are stored rows of :func:`yield_training_rows`."""
    rows = agri if vocab is None else yield_training_rows(agri, vocab)
    return _fit(rows, YIELD_FEATURES, "Production", seed, vocab is None, **options)


def fit_price(prices: DataFrame, vocab: DataFrame | None, seed: int = 7, **options) -> Model:
    """Boosted trees for the modal price of a market row. Without a vocabulary ``prices``
    are stored rows of :func:`price_training_rows`."""
    rows = prices if vocab is None else price_training_rows(prices, vocab)
    return _fit(rows, PRICE_FEATURES, "Modal_Price", seed, vocab is None, **options)


def _score(df: DataFrame, model: Model, names: list[str], out: str) -> DataFrame:
    scored = model.transform(_features(df, names))
    return scored.withColumn(out, clamp("prediction")).drop("features", "prediction")


def score_yield(df: DataFrame, model: Model) -> DataFrame:
    """Add ``predicted_yield`` in tonnes, not below zero."""
    return _score(df, model, YIELD_FEATURES, "predicted_yield")


def score_price(df: DataFrame, model: Model, scaled: bool = True) -> DataFrame:
    """Add ``predicted_price`` per quintal, not below zero. Without ``scaled`` the
    prices of the caller go to the model as they are."""
    if not scaled:
        df = df.withColumns(
            {"min_price_scaled": F.col("min_price"), "max_price_scaled": F.col("max_price")}
        )
    return _score(df, model, PRICE_FEATURES, "predicted_price")


def total_value() -> Column:
    """Revenue: tonnes times price per quintal, ten quintals to the tonne."""
    return F.col("predicted_yield") * F.col("predicted_price") * 10


def valuation(df: DataFrame) -> DataFrame:
    return df.withColumn("total_value", total_value())


def confidence_rating(has_history: Column) -> Column:
    return F.when(has_history, "HIGH").otherwise("MODERATE")


def confidence(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """HIGH where the key of a request has history, else MODERATE."""
    known = defaults.select("State", "District", "Crop", F.lit(True).alias("_known"))
    df = lookup(requests, known, REQUEST_KEY, source=defaults)
    rating = confidence_rating(F.coalesce("_known", F.lit(False)))
    return df.withColumn("confidence_rating", rating).drop("_known")


def synthetic_history() -> Column:
    """Five years around a prediction, for a key without history."""
    base = F.when(F.col("area") > 0, safe_ratio("predicted_yield", "area")).otherwise(K.SYNTHETIC_YIELD)
    return F.array(
        *[
            F.struct(
                F.lit(year).alias("year"),
                round_even(base * y, 4).alias("yield"),
                round_even(F.col("predicted_price") * p, 2).alias("price"),
            )
            for year, y, p in K.SYNTHETIC_HISTORY
        ]
    )


def history_or_synthetic(predictions: DataFrame, trends: DataFrame) -> DataFrame:
    """Add ``historical_trend``: the known trend of the key or a synthetic one.
    ``trends`` should be stored or materialised."""
    nested = derived(trends, "nested", nest_trends).withColumnRenamed("historical_trend", "_trend")
    df = lookup(predictions, nested, REQUEST_KEY, source=trends)
    kind = "array<struct<year:int,yield:double,price:double>>"
    trend = F.coalesce(F.col("_trend").cast(kind), synthetic_history().cast(kind))
    return df.withColumn("historical_trend", trend).drop("_trend")


def prediction_log_rows(predictions: DataFrame) -> DataFrame:
    """Log columns of the predictions that reached scoring.

    A request that validation rejects is answered and not logged, see
    :func:`rejected_requests`. One whose scoring failed, with a text in the column
    ``error``, is logged with zeros and that text.
    """
    scored = predictions.filter(F.col("reason").isNull())
    error = F.col("error") if "error" in predictions.columns else F.lit(None).cast("string")
    zero = F.lit(0.0)
    results = {
        c: F.when(error.isNotNull(), zero).otherwise(F.col(c))
        for c in ("predicted_yield", "predicted_price", "total_value")
    }
    status = F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise("SUCCESS")
    logged = scored.withColumns({**results, "status": status})
    if "rainfall_raw" in logged.columns:
        logged = logged.withColumn("rainfall", F.col("rainfall_raw"))
    return logged


def rejected_requests(predictions: DataFrame) -> DataFrame:
    """Requests that validation rejected, with the reason that the caller gets."""
    return predictions.filter(F.col("reason").isNotNull()).select("req_id", "reason")
