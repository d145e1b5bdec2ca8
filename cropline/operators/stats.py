"""Profiling, correlation and linear fits. Every statistic is a mergeable aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cropline.functions.constants import RAIN_COLUMNS, SEASON_TOTALS
from cropline.functions.joins import lookup
from cropline.functions.ranking import ACCURACY, exact_quantiles, sketch
from cropline.functions.scalars import not_nan, strip, upper_key
from cropline.operators.clean import drop_nulls, standardise, to_numeric
from cropline.session import materialise


def join_rainfall(agri: DataFrame, rain: DataFrame) -> DataFrame:
    """Facts with the rainfall of their subdivision and year.

    Rainfall has one row per subdivision and year; it is stored, counted and
    broadcast, so the facts are not shuffled. Beyond the size limit the hot keys
    of the facts are split.
    """
    left = agri.withColumn("sub_clean", upper_key("SUBDIVISION")).withColumnRenamed(
        "SUBDIVISION", "SUBDIVISION_x"
    )
    right = rain.withColumn("_sub", upper_key("SUBDIVISION")).withColumnsRenamed(
        {"SUBDIVISION": "SUBDIVISION_y", "YEAR": "_year"}
    )
    return lookup(left, materialise(right), {"sub_clean": "_sub", "Year": "_year"}, "inner")


def join_prices(agri: DataFrame, means: DataFrame) -> DataFrame:
    """Facts with the mean prices of their state, district and year; the scaled
    prices of the facts end in ``_x``, the raw means in ``_y``. The means are few
    and broadcast after a check of their number."""
    left = agri.withColumns({"State": upper_key("State"), "District": upper_key("District")})
    left = left.withColumnsRenamed({"Min_Price": "Min_Price_x", "Max_Price": "Max_Price_x"})
    right = means.withColumnsRenamed({"Min_Price": "Min_Price_y", "Max_Price": "Max_Price_y"})
    return lookup(left, materialise(right), {k: k for k in ("State", "District", "Year")}, "inner")


def _moments(x: str) -> list[Column]:
    """Count, mean, sum of squared deviations and extremes of a column."""
    value = not_nan(x)
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("x"),
        (F.var_pop(value) * F.count(value)).alias("xx"),
        F.min(value).alias("x_low"),
        F.max(value).alias("x_high"),
    ]


def _fits_of_moments(groups: DataFrame, by: list[str]) -> DataFrame:
    """Correlation and least squares of ``x`` against ``y`` per group.

    ``groups`` holds moments of ``x`` over rows that share one ``y``, so it is
    as small as the table ``y`` comes from. Deviations are taken from the means
    of the whole group first, as sums of squares would cancel.
    """
    whole = Window.partitionBy(*by)
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    complete = groups.filter((n > 0) & y.isNotNull() & ~F.isnan(y))
    centred = complete.withColumn("_n", F.sum(n).over(whole))
    centred = centred.withColumns({"_x": F.sum(n * x).over(whole) / F.col("_n"), "_y": F.sum(n * y).over(whole) / F.col("_n")})
    dx, dy = x - F.col("_x"), y - F.col("_y")
    sums = centred.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.first("_x").alias("_x"),
        F.first("_y").alias("_y"),
        F.sum(F.col("xx") + n * dx * dx).alias("_xx"),
        F.sum(n * dy * dy).alias("_yy"),
        F.sum(n * dx * dy).alias("_xy"),
        (F.min("x_low") < F.max("x_high")).alias("_x_varies"),
        (F.min("y") < F.max("y")).alias("_y_varies"),
    )
    slope = F.when(F.col("_x_varies"), F.try_divide("_xy", "_xx"))
    both = F.col("_x_varies") & F.col("_y_varies")
    return sums.select(
        *by,
        F.when(both, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))).alias("correlation"),
        "n",
        slope.alias("slope"),
        (F.col("_y") - slope * F.col("_x")).alias("intercept"),
        F.when(both, F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy"))).alias("r2"),
    )


def _rain_fits(agri: DataFrame, rain: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Fits of the scaled rainfall of the facts against each rainfall column.

    Rainfall is constant per subdivision and year, so the facts are reduced to
    their moments per key before the join, and no fact row is copied per column.
    """
    facts = agri.withColumns({"_sub": upper_key("SUBDIVISION"), "Season": strip("Season")})
    reduced = facts.groupBy(*by, "_sub", "Year").agg(*_moments("Rainfall"))
    numeric = to_numeric(rain, [c for c in cols if dict(rain.dtypes)[c] == "string"])
    pairs = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("double").alias("y"))
        for i, c in enumerate(cols)
    ]
    long = numeric.select(
        upper_key("SUBDIVISION").alias("_rain_sub"), F.col("YEAR").alias("_rain_year"), F.inline(F.array(*pairs))
    )
    same = (F.col("_sub") == F.col("_rain_sub")) & (F.col("Year") == F.col("_rain_year"))
    return _fits_of_moments(reduced.join(long, same), [*by, "position", "column"])


def rank_rainfall(agri: DataFrame, rain: DataFrame, cols: list[str] = RAIN_COLUMNS) -> DataFrame:
    """Rainfall columns by absolute correlation with the facts' rainfall; undefined
    counts as 0 and ties keep the order of ``cols``."""
    order = Window.orderBy(F.abs(F.coalesce("correlation", F.lit(0.0))).desc(), "position")
    found = _rain_fits(agri, rain, cols, [])
    return found.select(F.row_number().over(order).alias("rank"), "column", "correlation")


def best_rainfall(agri: DataFrame, rain: DataFrame, cols: list[str] = SEASON_TOTALS) -> DataFrame:
    """Per season, the rainfall column most correlated with the scaled rainfall of
    the facts, with the fit; the first of equals wins."""
    strength = F.struct(F.abs(F.coalesce("correlation", F.lit(0.0))), -F.col("position"))
    details = F.struct("column", "correlation", "n", "slope", "intercept", "r2")
    found = _rain_fits(agri, rain, cols, ["Season"])
    return found.groupBy("Season").agg(F.max_by(details, strength).alias("best")).select("Season", "best.*")


def fit_price_scale(
    agri: DataFrame, means: DataFrame, cols: list[str] = ["Min_Price", "Max_Price"], min_rows: int = 10
) -> DataFrame:
    """Per price column, least squares of the district means against the scaled
    prices of the facts, over more than ``min_rows`` joined rows.

    A mean is constant per state, district and year: the facts are reduced to
    moments by that key before the join.
    """
    keys = ["State", "District", "Year"]
    facts = agri.withColumns({"State": upper_key("State"), "District": upper_key("District")})
    reduced = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.struct(*_moments(c)).alias(f"_of_{c}") for c in cols]
    )
    joined = reduced.join(means.select(*keys, *cols), keys)
    sides = [F.struct(F.lit(c).alias("price"), F.col(c).alias("y"), F.col(f"_of_{c}").alias("m")) for c in cols]
    long = joined.select("_rows", F.inline(F.array(*sides))).select("_rows", "price", "y", "m.*")
    sizes = long.groupBy("price").agg(F.sum("_rows").alias("_size"))
    fits = _fits_of_moments(long, ["price"]).join(sizes, "price")
    return fits.filter(F.col("_size") > min_rows).select("price", "n", "slope", "intercept", "r2")


def global_moments(prices: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the prices of complete rows."""
    complete = drop_nulls(prices, ["Min_Price", "Max_Price"])
    return complete.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("Min_Price").alias("mean_min"),
        F.avg("Max_Price").alias("mean_max"),
        F.stddev_samp("Min_Price").alias("std_min"),
        F.stddev_samp("Max_Price").alias("std_max"),
    )


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum of each column the table has."""
    present = [c for c in cols if c in df.columns]
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(not_nan(c)).alias("mean"),
            F.stddev_samp(not_nan(c)).alias("std"),
            F.min(not_nan(c)).alias("min"),
            F.max(not_nan(c)).alias("max"),
        )
        for c in present
    ]
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


QUARTILES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, name: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of one column.

    Two passes: one for the moments and the sketch of the quartiles, one to make
    the quartiles exact.
    """
    value = not_nan(name)
    moments = {
        "count": F.count(value).cast("double"),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
    }
    summary = materialise(
        df.agg(
            *[c.alias(n) for n, c in moments.items()],
            sketch(name, QUARTILES, ACCURACY).alias("_edges"),
            F.count(value).alias("_total"),
        )
    )
    wide = F.array(
        *[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in moments]
    )
    quartiles = exact_quantiles(df, name, QUARTILES, summary).select(
        F.concat((F.col("probability") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        F.col("quantile").alias("value"),
    )
    return summary.select(F.inline(wide)).unionByName(quartiles)


def describe_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """Description of ``a`` minus the standardised ``b``.

    The input is read twice, for the moments of ``b`` and for the difference,
    which is stored as a table of one column.
    """
    pair = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    return describe(materialise(standardise(pair, "_b").select((F.col("_a") - F.col("_b")).alias("_d"))), "_d")


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over the rows that have both values; null if undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row per pair of columns."""
    found = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), correlation(x, y).alias("correlation"))
        for x, y in pairs
    ]
    return df.agg(F.array(*found).alias("found")).select(F.inline("found"))


def _pairwise(df: DataFrame, target: str, cols: list[str], by: list[str]) -> DataFrame:
    """Rows ``(by, position, column, x, y)``: ``target`` with each of ``cols``.

    One aggregate over this form replaces an aggregate with several buffers per
    column, which grows too large for generated code.
    """
    numeric = to_numeric(df, [c for c in cols if dict(df.dtypes)[c] == "string"])
    pairs = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("double").alias("y"))
        for i, c in enumerate(cols)
    ]
    return numeric.select(*by, F.col(target).alias("x"), F.inline(F.array(*pairs)))


def rank_correlations(df: DataFrame, target: str, cols: list[str] = RAIN_COLUMNS) -> DataFrame:
    """Columns by absolute correlation with ``target``; undefined counts as 0 and
    ties keep the order of ``cols``."""
    found = (
        _pairwise(df, target, cols, [])
        .groupBy("position", "column")
        .agg(correlation("x", "y").alias("correlation"))
    )
    order = Window.orderBy(F.abs(F.coalesce("correlation", F.lit(0.0))).desc(), "position")
    return found.select(F.row_number().over(order).alias("rank"), "column", "correlation")


def _best_by_season(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per season, correlation and fit of the rainfall column most correlated with
    the scaled rainfall; the first of equals wins."""
    pairs = _pairwise(df.withColumn("Season", strip("Season")), "Rainfall", cols, ["Season"])
    slope, intercept, share, size = _fit("x", "y")
    found = pairs.groupBy("Season", "position", "column").agg(
        correlation("x", "y").alias("correlation"),
        size.alias("n"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        share.alias("r2"),
    )
    strength = F.struct(F.abs(F.coalesce("correlation", F.lit(0.0))), -F.col("position"))
    details = F.struct("column", "correlation", "n", "slope", "intercept", "r2")
    return found.groupBy("Season").agg(F.max_by(details, strength).alias("best")).select("Season", "best.*")


def best_rain_column(df: DataFrame, cols: list[str] = SEASON_TOTALS) -> DataFrame:
    """Per season, the rainfall column most correlated with the scaled rainfall."""
    return _best_by_season(df, cols).select("Season", "column", "correlation")


def fit_best_rain(df: DataFrame, cols: list[str] = SEASON_TOTALS, min_rows: int = 5) -> DataFrame:
    """Per season, the fit of its best rainfall column, given more than ``min_rows`` pairs."""
    return _best_by_season(df, cols).filter(F.col("n") > min_rows)


def _fit(x: str, y: str) -> tuple[Column, Column, Column, Column]:
    """Slope, intercept, R² and number of complete pairs; R² of a constant ``y`` is null."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return (
        F.regr_slope(b, a),
        F.regr_intercept(b, a),
        F.when(F.var_pop(b) > 0, F.regr_r2(b, a)),
        F.count(a),
    )


def fit_scale(
    df: DataFrame, x: str, y: str, by: list[str] = [], min_rows: int = 5, count_pairs: bool = True
) -> DataFrame:
    """Least squares ``y = slope * x + intercept`` with R², per group.

    Slope and intercept are the standard deviation and mean behind a z-score
    ``x``. Groups need more than ``min_rows`` rows, counted over complete pairs
    or, without ``count_pairs``, over all rows.
    """
    slope, intercept, share, pairs = _fit(x, y)
    fits = df.groupBy(*by).agg(
        pairs.alias("n"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        share.alias("r2"),
        (pairs if count_pairs else F.count(F.lit(1))).alias("_size"),
    )
    return fits.filter(F.col("_size") > min_rows).drop("_size")


def r2(df: DataFrame, y: str, fitted: str) -> DataFrame:
    """Share of the variance of ``y`` that ``fitted`` explains."""
    complete = drop_nulls(df, [y, fitted])
    residual = F.sum(F.pow(F.col(y) - F.col(fitted), 2))
    total = F.var_pop(y) * F.count(F.lit(1))
    return complete.agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(residual, total)).alias("r2"))


def sample_pairs(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """Per season, the first row of each (year, subdivision), and the first ``n`` of those.

    The first row per pair is an aggregate, so that no task sorts all rows of a
    large pair; the ranking then sees one row per pair.
    """
    order = F.struct(*order_by)
    rest = [c for c in df.columns if c not in ("Season", "Year", "sub_clean")]
    first = df.groupBy("Season", "Year", "sub_clean").agg(
        F.min_by(F.struct(*rest), order).alias("_row"), F.min(order).alias("_order")
    )
    ranked = first.withColumn(
        "sample", F.row_number().over(Window.partitionBy("Season").orderBy("_order", "Year", "sub_clean"))
    )
    return ranked.filter(F.col("sample") <= n).select("Season", "sample", "Year", "sub_clean", "_row.*")


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def distinct_head(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.select(name).distinct().orderBy(name).limit(n)
