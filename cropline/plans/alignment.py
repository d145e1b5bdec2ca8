"""Refreshing one state of the fact table from raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cropline.functions.constants import CROP_ALIASES
from cropline.operators.align import align_state, replace_state
from cropline.session import materialise
from cropline.sources.files import STATE_KEY, publish_agri, publish_states, read_states


def refresh_state(
    base: DataFrame,
    production: DataFrame,
    prices: DataFrame,
    rain: DataFrame,
    state: str,
    subdivision: str,
    root: str,
    version: str,
    aliases: dict[str, list[str]] = CROP_ALIASES,
    file_format: str = "csv",
) -> str:
    """Align the state, replace its rows and publish the result as a new version."""
    aligned = align_state(production, prices, rain, state, subdivision, aliases)
    return publish_agri(replace_state(base, aligned, state), root, version, file_format)


def refresh_partition(
    path: str,
    production: DataFrame,
    prices: DataFrame,
    rain: DataFrame,
    state: str,
    subdivision: str,
    aliases: dict[str, list[str]] = CROP_ALIASES,
) -> str:
    """Align the state and replace its rows in facts published by state.

    Only the state's own partition is read and written, in a new version that has the files
    of all other states as they are. No new rows for a state that has old ones is an error.
    """
    spark = production.sparkSession
    aligned = materialise(align_state(production, prices, rain, state, subdivision, aliases))
    if aligned.isEmpty():
        old = read_states(spark, path).filter(F.col(STATE_KEY) == state.upper())
        if old.isEmpty():
            return path
        raise ValueError(f"no new rows for {state}: remove its partition instead")
    return publish_states(aligned, path)
