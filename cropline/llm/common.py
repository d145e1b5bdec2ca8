"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cropline.functions.joins import fits_broadcast

# The white space of all word rules here: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as no column has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_matches(rows: DataFrame, losers: DataFrame, on: dict[str, str]) -> DataFrame:
    """``rows`` without those that match ``losers``; nulls match nulls.

    ``losers`` must be stored. It is counted, and broadcast up to 100,000 rows,
    so that ``rows`` with their texts stay where they are; beyond that both
    sides are shuffled and adaptive execution splits skewed partitions.
    """
    hidden = {c: fresh(rows.columns, f"_loser{i}") for i, c in enumerate(on.values())}
    keys = losers.select(*[column(c).alias(h) for c, h in hidden.items()])
    same = None
    for own, other in on.items():
        equal = column(own).eqNullSafe(F.col(hidden[other]))
        same = equal if same is None else same & equal
    return rows.join(F.broadcast(keys) if fits_broadcast(losers) else keys, same, "left_anti")
