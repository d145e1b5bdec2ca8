"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cropline.functions.constants import SCALING

WHITESPACE = " \t\r\n\f\v"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(column(c), F.lit(WHITESPACE))


def upper_key(c: Column | str) -> Column:
    return F.upper(strip(c))


def lower_key(c: Column | str) -> Column:
    return F.lower(strip(c))


def parse_double(c: Column | str) -> Column:
    """Number in a text, null where there is none.

    A cast would also take the Java suffixes of ``1.0d`` and ``1.0f``.
    """
    text = strip(column(c).cast("string"))
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))


def parse_int(c: Column | str) -> Column:
    """Whole number in a text; ``2003.0`` is not one."""
    text = strip(column(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def not_nan(c: Column | str) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    c = column(c)
    return F.when(~F.isnan(c), c)


def round_even(c: Column | str, digits: int) -> Column:
    """Scale, round half to even, unscale."""
    power = float(10**digits)
    return F.rint(column(c) * power) / power


def round_mean(c: Column | str, digits: int) -> Column:
    """Rounding for means of quotients: the last bits of a double, which depend on
    the order of the sum, are rounded off first, so that a tie stays a tie."""
    return round_even(round_even(c, digits + 5), digits)


# Below this a value is summed as integers; 10^12 such values fit their sums.
_WHOLE = float(1 << 43)


def exact_sum(c: Column | str) -> Column:
    """Sum in two parts, ``exact`` and ``rest``; see :func:`sum_value`.

    Prices and yields are short decimals, whose means often sit exactly on a
    rounding boundary; a sum of doubles would fall on either side of it
    depending on how the rows are partitioned. Their whole parts and eight
    decimals are summed as integers, in halves that do not overflow, and put
    together as a decimal once per group. What a value has beyond its eighth
    decimal, and values too large to split, are summed as doubles in ``rest``:
    nothing is cut off, infinities stay infinite and opposite ones give NaN. NaN
    counts as missing.
    """
    value = not_nan(c)
    split = F.abs(value) < _WHOLE
    small = F.when(split, value)
    whole = F.floor(small)
    digits = F.rint((small - whole) * 1e8).cast("bigint")
    left = small - whole - digits / F.lit(1e8)
    # A smaller remainder is the rounding of the value itself.
    beyond = F.when(F.abs(left) > F.abs(small) * 2.3e-16, left).otherwise(0.0)

    def halves(n: Column, bits: int) -> Column:
        high = F.sum(F.shiftright(n, bits)).cast("decimal(19,0)")
        low = F.sum(n.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))).cast("decimal(19,0)")
        return high * F.lit(1 << bits).cast(f"decimal({len(str(1 << bits))},0)") + low

    exact = halves(whole, 20) + halves(digits, 13) * F.lit("0.00000001").cast("decimal(8,8)")
    rest = F.sum(F.when(split, beyond).otherwise(value))
    return F.struct(exact.cast("decimal(38,8)").alias("exact"), rest.alias("rest"))


def add_sums(c: Column | str) -> Column:
    """Total of two-part sums."""
    c = column(c)
    return F.struct(F.sum(c["exact"]).cast("decimal(38,8)").alias("exact"), F.sum(c["rest"]).alias("rest"))


def sum_value(c: Column | str) -> Column:
    """A two-part sum as a number; null if nothing was summed."""
    c = column(c)
    return F.coalesce(c["exact"].cast("double") + c["rest"], c["rest"])


def exact_mean(c: Column | str) -> Column:
    return F.try_divide(sum_value(exact_sum(c)), F.count(not_nan(c)))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, 0.0 where the denominator is not positive."""
    denominator = column(denominator)
    return F.when(denominator > 0, F.try_divide(column(numerator), denominator)).otherwise(0.0)


def scale(c: Column | str, feature: str) -> Column:
    mean, std = SCALING[feature]
    return (column(c) - mean) / std


def unscale(c: Column | str, feature: str) -> Column:
    mean, std = SCALING[feature]
    return column(c) * std + mean


def clamp(c: Column | str) -> Column:
    """Not below zero; NaN counts as zero."""
    return F.greatest(F.lit(0.0), F.nanvl(column(c), F.lit(0.0)))


def swapped(low: Column, high: Column) -> Column:
    """Whether two bounds stand in the wrong order; NaN compares as false."""
    return (low > high) & ~F.isnan(low) & ~F.isnan(high)


def order_bounds(low: Column | str, high: Column | str) -> tuple[Column, Column]:
    """Clamp both bounds at zero, then put the smaller one first."""
    low, high = clamp(low), clamp(high)
    swap = swapped(low, high)
    return F.when(swap, high).otherwise(low), F.when(swap, low).otherwise(high)
