"""Scoring requests as they arrive."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from cropline.functions.constants import COLD_START_STATES
from cropline.operators.scoring import prediction_log_rows
from cropline.plans.artefacts import Artefacts
from cropline.plans.prediction import predict
from cropline.sources.files import prediction_rows
from cropline.streaming.monitor import append_log


def predict_stream(
    requests: DataFrame,
    artefacts: Artefacts,
    as_of: date,
    log_path: str,
    checkpoint: str,
    yield_model: Model | None = None,
    price_model: Model | None = None,
    cold_start_states: tuple[str, ...] | None = COLD_START_STATES,
    user: str = "username",
) -> StreamingQuery:
    """Predict each micro-batch of a request stream and append to the prediction log.

    A repeated batch replaces itself, so that every request is logged once.
    Rejected requests are not logged. ``req_id`` becomes the log id.
    """

    def rows(batch: DataFrame) -> DataFrame:
        scored = predict(batch, artefacts, as_of, yield_model, price_model, cold_start_states)
        return prediction_rows(
            prediction_log_rows(scored).withColumns(
                {"id": F.col("req_id"), "username": F.col(user) if user in batch.columns else F.lit("batch")}
            )
        )

    return append_log(requests, rows, log_path, checkpoint)
