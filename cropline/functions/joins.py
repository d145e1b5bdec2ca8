"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, functions as F

from cropline.session import materialise

# A table that is broadcast has at most so many rows, and bytes as JSON text.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 128 << 20
HOT_SHARE = 1e-5
HOT_ROWS = 1_000_000


_sizes: WeakKeyDictionary[DataFrame, dict[tuple[int, int], bool]] = WeakKeyDictionary()


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes.

    Rows with arrays or long texts can be few and large, hence the second bound.
    Runs a job over at most ``rows + 1`` rows, once per table: ``df`` should be
    stored or materialised.
    """
    known = _sizes.setdefault(df, {})
    if (rows, size) not in known:
        text = F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))
        count, length = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
        known[rows, size] = count <= rows and (length or 0) <= size
    return known[rows, size]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _stored_counts(counts: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """``counts`` of the keys with more than ``min_rows`` rows, the others' in one row, stored."""
    large = F.col("_rows") > min_rows
    grouped = counts.groupBy(large.alias("_large"), *[F.when(large, F.col(k)).alias(k) for k in keys])
    return materialise(grouped.agg(F.sum("_rows").alias("_rows")))


def spread_hot_keys(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    chained: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a part number, ``_part`` and ``_rpart``.

    A key is hot if it has more than ``share`` of the rows of ``left``, and at
    least ``min_rows``; it is spread over parts of about that many rows and its
    rows of ``right`` are repeated once per part. There are fewer than
    ``1 / share`` hot keys with at most ``2 / share`` parts together, which
    bounds the broadcast and the repetition. Every other key has one part. The
    part of a row is a hash of the row, hence the same when a task is run again.

    The plan holds ``left`` five times, as its keys are counted in it, so that of ``n`` such
    joins in a row holds the first 5^n times. If ``chained`` the keys are counted by a job of
    its own and the plan holds ``left`` once.
    """
    keys, right_keys = list(on), [f"_k{i}" for i in range(len(on))]
    hidden = [f"_h{i}" for i in range(len(on))]
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if chained:
        counts = _stored_counts(counts, keys, min_rows)
    total = counts.agg(F.sum("_rows").alias("_total")).scalar()
    limit = F.greatest(total * share, F.lit(float(min_rows)))
    hot = F.broadcast(
        (counts.filter("_large") if chained else counts)
        .withColumn("_limit", limit)
        .filter(F.col("_rows") > F.col("_limit"))
        .select(
            *[F.col(k).alias(h) for k, h in zip(keys, hidden)],
            F.ceil(F.col("_rows") / F.col("_limit")).cast("int").alias("_parts"),
        )
    )

    def tagged(df: DataFrame, columns: list[str]) -> DataFrame:
        same = _all([F.col(c).eqNullSafe(F.col(h)) for c, h in zip(columns, hidden)])
        return df.join(hot, same, "left").drop(*hidden)

    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    part = F.coalesce(F.pmod(whole_row, F.col("_parts")), F.lit(0)).cast("int")
    spread = tagged(left, keys).withColumn("_part", part).drop("_parts")
    every_part = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    repeated = tagged(_rename_keys(right, on), right_keys).withColumn("_rpart", F.explode(every_part))
    return spread, repeated.drop("_parts")


def split_hot_keys(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    how: str = "left",
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    chained: bool = False,
) -> DataFrame:
    """Shuffle join of ``left`` with ``right`` that splits the hot keys of ``left``.

    Adaptive execution splits a skewed partition only where both inputs are
    bare shuffles. Here ``right`` is often an aggregate on the join keys, which
    hides its shuffle, so the hot keys are split in the plan.
    """
    spread, repeated = spread_hot_keys(left, right, on, share, min_rows, chained)
    condition = _all([F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)])
    joined = spread.join(repeated, condition & (F.col("_part") == F.col("_rpart")), how)
    return joined.drop("_part", "_rpart", *[f"_k{i}" for i in range(len(on))])


def _rename_keys(right: DataFrame, on: dict[str, str]) -> DataFrame:
    used = {c.lower() for c in on.values()}
    return right.select(
        *[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())],
        *[F.col(f"`{c}`") for c in right.columns if c.lower() not in used],
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    how: str = "left",
    source: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    chained: bool = False,
) -> DataFrame:
    """Join ``left`` with a lookup table.

    ``on`` maps columns of ``left`` to key columns of ``right``; only the other
    columns of ``right`` are added. The table, or the materialised ``source`` that
    it has at most as many rows as, is counted: up to ``broadcast_rows`` rows it
    is broadcast and ``left`` is not shuffled, beyond that the join is shuffled
    with its hot keys split. ``chained`` says that ``left`` is the result of another
    lookup or is looked up again, see :func:`spread_hot_keys`.
    """
    if not fits_broadcast(source if source is not None else right, broadcast_rows):
        return split_hot_keys(left, right, on, how, chained=chained)
    named = F.broadcast(_rename_keys(right, on))
    condition = _all([F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)])
    return left.join(named, condition, how).drop(*[f"_k{i}" for i in range(len(on))])
