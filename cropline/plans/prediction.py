"""Batch prediction of a table of requests, from validation to published results."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, functions as F

from cropline.functions.constants import COLD_START_STATES, GENERIC_VARIETY, PREFERRED_GRADE
from cropline.functions.scalars import clamp, round_even
from cropline.operators.aggregates import fallback_yield
from cropline.operators.clean import normalise_requests, resolve_inputs, validate_requests
from cropline.operators.matching import encode, match_category, match_contains, match_either, preferred
from cropline.operators.scoring import (
    confidence_rating,
    history_or_synthetic,
    score_price,
    score_yield,
    valuation,
)
from cropline.plans.artefacts import Artefacts
from cropline.session import materialise


def _filled(given: str, default: Column) -> Column:
    """A given text, unless it is missing or empty."""
    return F.when(F.coalesce(F.col(given), F.lit("")) == "", default).otherwise(F.col(given))


def choose_market_inputs(requests: DataFrame, vocab: DataFrame) -> DataFrame:
    """Market, variety and grade: the given one, else one that fits the request."""
    df = match_contains(requests, vocab, "district", "market", "_market")
    df = match_contains(df, vocab, "crop", "variety", "_variety", GENERIC_VARIETY)
    return df.withColumns(
        {
            "market": _filled("market", F.col("_market")),
            "variety": _filled("variety", F.col("_variety")),
            "grade": _filled("grade", preferred(vocab, "grade", PREFERRED_GRADE)),
        }
    ).drop("_market", "_variety")


def encode_price_inputs(requests: DataFrame, vocab: DataFrame) -> DataFrame:
    """Codes of the six price categories."""
    plain = {c: c for c in ("state", "district", "market", "variety", "grade")}
    df = encode(requests, vocab, plain)
    df = match_either(df, vocab, "commodity", "crop", "commodity", "commodity")
    return df


def predict(
    requests: DataFrame,
    artefacts: Artefacts,
    as_of: date,
    yield_model: Model | None = None,
    price_model: Model | None = None,
    cold_start_states: tuple[str, ...] | None = COLD_START_STATES,
    latency_ms: Column | None = None,
) -> DataFrame:
    """Score every request; one output row per input row.

    Requests from ``cold_start_states`` get the mean yield of their history; the
    others are scored by ``yield_model``. Without a model every yield comes from
    history; without ``price_model`` the price is the request's ``given_price``.
    A rejected request has a ``reason`` and no results. The working columns that
    the log needs are kept: see :func:`published`.
    """
    price_vocab = artefacts.price_vocab
    # The words to look up and the results both read the checked requests.
    df = materialise(validate_requests(normalise_requests(requests, as_of)))
    df = choose_market_inputs(df, price_vocab)
    df = resolve_inputs(df, artefacts.defaults)
    rejected = None
    if yield_model is not None or price_model is not None:
        # Models see the valid rows only.
        df = materialise(df)
        rejected = df.filter(F.col("reason").isNotNull())
        df = df.filter(F.col("reason").isNull())

    if yield_model is None:
        df = fallback_yield(df, artefacts.trends)
    else:
        df = fallback_yield(df, artefacts.trends, cold_start_states).withColumnRenamed(
            "predicted_yield", "_cold_yield"
        )
        production = artefacts.production_vocab
        for c in ("state", "crop", "season"):
            df = match_category(df, production, c, c)
        df = score_yield(df, yield_model)
        df = df.withColumn("predicted_yield", F.coalesce("_cold_yield", "predicted_yield")).drop("_cold_yield")
        df = df.drop(*[f"{c}_{part}" for c in ("state", "crop", "season") for part in ("code", "value")])
    if price_model is None:
        df = df.withColumn("predicted_price", clamp(F.col("given_price").cast("double")))
    else:
        df = score_price(encode_price_inputs(df, price_vocab), price_model)
    if rejected is not None:
        df = df.unionByName(rejected, allowMissingColumns=True)

    valid = F.col("reason").isNull()
    df = df.withColumns({c: F.when(valid, F.col(c)) for c in ("predicted_yield", "predicted_price")})
    df = valuation(df).withColumn("latency_ms", F.lit(0.0) if latency_ms is None else latency_ms)
    return history_or_synthetic(df, artefacts.trends)


def published(predictions: DataFrame) -> DataFrame:
    """Rounded results of the valid requests, with the inputs that were used."""
    inputs = F.struct(
        "market", "variety", "grade",
        round_even("min_price_raw", 2).alias("min_price"),
        round_even("max_price_raw", 2).alias("max_price"),
        round_even("rainfall_raw", 1).alias("rainfall"),
    )
    return predictions.filter(F.col("reason").isNull()).select(
        "req_id",
        F.lit("success").alias("status"),
        "crop", "state", "district", "season", "area",
        round_even("predicted_yield", 2).alias("predicted_yield_tonnes"),
        round_even("predicted_price", 2).alias("predicted_price_inr_quintal"),
        round_even("total_value", 2).alias("total_estimated_value_inr"),
        round_even("latency_ms", 2).alias("latency_ms"),
        confidence_rating(F.col("has_history")).alias("confidence_rating"),
        "historical_trend",
        inputs.alias("inputs_used"),
    )
