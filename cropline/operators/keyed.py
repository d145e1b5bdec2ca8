"""Keyed inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """``existing`` plus one row per new key of ``incoming``, the first in ``order_by``.

    Incoming rows are reduced to one per key, partly before the shuffle, so a
    key that fills the batch costs no more than any other.
    """
    rest = [c for c in incoming.columns if c != key]
    winners = (
        incoming.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
        .select(key, "_row.*")
    )
    fresh = winners.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)
