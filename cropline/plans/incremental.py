"""Lookup tables kept up to date by partition of the facts.

The facts are published by state, each partition in a write of its own
(``sources.versions``). All lookup tables derive from sums and distinct values that merge, so
these are stored for every partition beside the write they were made from. After a
state was replaced only its rows are read; the others' sums are merged as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cropline.operators.aggregates import category_values, vocabulary, yearly_rollup
from cropline.plans.artefacts import YIELD_VOCABULARY, Artefacts, artefacts_of, load_artefacts, store_artefacts
from cropline.sources.files import STATE_KEY, read_states
from cropline.sources.versions import entries, read_partitions, versions, write_partitions

_KEY = T.StructField(STATE_KEY, T.StringType())


def stale_partitions(spark: SparkSession, facts: str, partials: str, version: int | None = None) -> tuple[list[str], list[str]]:
    """Partitions of the facts whose partials are missing or of an older write, and partials of none."""
    held, made = entries(spark, facts, version), entries(spark, partials)
    stale = [n for n, e in held.items() if made.get(n, {}).get("source") != e["write"]]
    return sorted(stale), sorted(n for n in made if n not in held)


def _values(agri: DataFrame) -> DataFrame:
    return category_values(agri, YIELD_VOCABULARY, "production", (STATE_KEY,))


def _sums(agri: DataFrame) -> DataFrame:
    return yearly_rollup(agri).withColumn(STATE_KEY, F.upper("State"))


def _refreshed(spark: SparkSession, facts: str, partials: str, make, version: int) -> DataFrame:
    """The partials of all partitions, after those of stale ones were made anew."""
    stale, gone = stale_partitions(spark, facts, partials, version)
    # The layout of partials follows from the facts'; nothing is read for it.
    layout = make(read_states(spark, facts, version, [])).drop(STATE_KEY).schema
    if stale or gone:
        held = entries(spark, facts, version)
        rows = make(read_states(spark, facts, version, stale)).select(*layout.names, STATE_KEY)
        source = {n: held[n]["write"] for n in stale}
        write_partitions(rows, partials, STATE_KEY, source=source, without=tuple(gone))
    return read_partitions(spark, partials, layout, _KEY).drop(STATE_KEY)


def refresh_artefacts(
    spark: SparkSession, facts: str, root: str, price_values: DataFrame | None = None, version: int | None = None
) -> Artefacts:
    """Lookup tables of a version of the facts, the newest one if none is given.

    Rows are read of the partitions that changed since the last call only. The result is
    stored under the version's number. ``price_values`` are the categories of the price model, as
    :func:`category_values` gives them.
    """
    known = version if version is not None else max(versions(spark, facts), default=None)
    if known is None:
        raise ValueError(f"nothing is published at {facts}")
    yearly = _refreshed(spark, facts, f"{root}/sums", _sums, known)
    values = _refreshed(spark, facts, f"{root}/values", _values, known).distinct()
    vocab = vocabulary(values if price_values is None else values.unionByName(price_values))
    store_artefacts(artefacts_of(yearly, vocab), root, str(known))
    return load_artefacts(spark, root, str(known))
