"""Positions and order statistics without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.functions.joins import fits_broadcast, split_hot_keys
from cropline.functions.scalars import not_nan
from cropline.session import materialise

ACCURACY = 100_000


# Up to this many rows a window may number a group in one task.
WINDOW_ROWS = 100_000


def ordinals(
    df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """0-based position of each row inside its key group, in ``order``.

    A table of at most ``window_rows`` rows is numbered by a window. A larger
    one is range-sorted across the cluster and numbered inside each sorted
    partition; the few partition sizes give the offsets. A window would sort
    each whole group in one task.
    """
    rows = materialise(df)
    if fits_broadcast(rows, window_rows):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(name, place - 1)
    numbered = materialise(
        rows.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    )
    # The id holds the partition in its upper 31 bits and the row in its lower 33.
    numbered = numbered.withColumn("_slice", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    per_slice = numbered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    placed = numbered.join(F.broadcast(offsets), F.col("_slice") == F.col("_s")).withColumn(
        "_position", F.col("_offset") + F.col("_row")
    )
    starts = placed.groupBy(*keys).agg(F.min("_position").alias("_start"))
    placed = split_hot_keys(placed, starts, {k: k for k in keys}, "inner")
    return placed.select(*df.columns, (F.col("_position") - F.col("_start")).cast("int").alias(name))


def sketch(value: str, probabilities: list[float], accuracy: int) -> Column:
    """Aggregate with two values around each quantile, as one array."""
    margin = 4.0 / accuracy
    edges: list[float] = []
    for p in probabilities:
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    return F.percentile_approx(not_nan(value), edges, accuracy)


def _running(counts: DataFrame, window_rows: int) -> DataFrame:
    """Add ``_last``: the rank of the last row of each ``(probability, _v)``."""
    ordered = F.col("_v").asc_nulls_first()
    if fits_broadcast(counts, window_rows):
        return counts.withColumn("_last", F.sum("_n").over(Window.partitionBy("probability").orderBy(ordered)) - 1)
    numbered = materialise(counts.orderBy("probability", ordered).withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_slice", F.shiftright("_id", 33))
    slices = numbered.groupBy(F.col("probability").alias("_p"), F.col("_slice").alias("_s")).agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_p", "_s", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"))
    same = (F.col("probability") == F.col("_p")) & (F.col("_slice") == F.col("_s"))
    upto = Window.partitionBy("probability", "_slice").orderBy("_id")
    return numbered.join(F.broadcast(offsets), same).withColumn(
        "_last", F.col("_offset") + F.sum("_n").over(upto) - 1
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    summary: DataFrame | None = None,
    accuracy: int = ACCURACY,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Quantiles with linear interpolation, one row ``(probability, quantile)`` each.

    A sketch brackets every quantile first. Only the distinct values inside the
    brackets, a share of ``8 / accuracy`` of the rows each, are then counted and
    walked in order, by a window while they are few and else in sorted partitions
    with offsets, so that no task sees the whole column or a whole large bracket. ``summary`` may hold
    the :func:`sketch` and the number of values in its row as ``_edges`` and
    ``_total``.
    """
    if summary is None:
        summary = materialise(
            df.agg(sketch(value, probabilities, accuracy).alias("_edges"), F.count(not_nan(value)).alias("_total"))
        )
    edges, total = summary.select("_edges").scalar(), summary.select("_total").scalar()
    targets = F.array(
        *[
            F.struct(
                F.lit(p).alias("probability"),
                F.element_at("_e", 2 * i + 1).alias("low"),
                F.element_at("_e", 2 * i + 2).alias("high"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    # Values below a bracket only add to its starting rank and are counted
    # together, values above it are not needed.
    placed = (
        df.select(not_nan(value).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .withColumn("_e", edges)
        .withColumn("_t", F.explode(targets))
        .filter(F.col("_v") <= F.col("_t.high"))
        .groupBy(
            F.col("_t.probability").alias("probability"),
            F.when(F.col("_v") >= F.col("_t.low"), F.col("_v")).alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = materialise(placed)
    position = F.col("probability") * (F.col("_total") - 1)
    ranked = (
        _running(placed, window_rows)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
        .withColumn("_total", total)
    )

    def at(rank: Column) -> Column:
        inside = (F.col("_first") <= rank) & (rank <= F.col("_last"))
        return F.max(F.when(inside, F.col("_v")))

    picked = ranked.groupBy("probability").agg(
        at(F.floor(position)).alias("_low"),
        at(F.ceil(position)).alias("_high"),
        F.first(position - F.floor(position)).alias("_part"),
    )
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    problem = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    return picked.select("probability", F.when(missed, problem).otherwise(between).alias("quantile"))
