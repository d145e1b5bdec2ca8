import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cropline.functions import constants as K
from cropline.functions.scalars import exact_mean, order_bounds, parse_double, parse_int, round_even, scale, unscale
from cropline.operators import clean as C
from cropline.operators.aggregates import crop_trends

AS_OF = date(2024, 6, 15)
DEFAULTS = "State string, District string, Crop string, rainfall double, min_price double, max_price double"
REQUEST = (
    "req_id long, state string, district string, crop string, season string, area string,"
    " has_rainfall boolean, rainfall double, min_price double, max_price double"
)


def test_normalise_strips_all_blanks(frame):
    df = frame("a string, b string, c string", [("\t x y\n", " AbC ", "  Rice\r")])
    row = C.normalise(df, upper=["a"], lower=["b"], plain=["c"]).first()
    assert tuple(row) == ("X Y", "abc", "Rice")


@pytest.mark.parametrize(
    "text, value",
    [("", None), (" 12 ", 12.0), ("n/a", None), ("1.0d", None), ("3f", None), ("1e3", 1000.0), ("-2.5", -2.5), (None, None)],
)
def test_dirty_numbers(frame, text, value):
    assert frame("x string", [(text,)]).select(parse_double("x")).first()[0] == value


@pytest.mark.parametrize("text, value", [("2003", 2003), (" 2003 ", 2003), ("2003.0", None), ("FY98", None), ("", None)])
def test_whole_numbers(frame, text, value):
    assert frame("x string", [(text,)]).select(parse_int("x")).first()[0] == value


def test_to_numeric_reads_nan_as_missing(frame):
    df = C.to_numeric(frame("x string", [("NaN",), ("7",)]), ["x"])
    assert [r.x for r in df.collect()] == [None, 7.0]


def test_drop_nulls_in_any_column(frame):
    rows = [(1.0, 2.0), (None, 2.0), (1.0, float("nan")), (3.0, 4.0)]
    assert C.drop_nulls(frame("a double, b double", rows), ["a", "b"]).count() == 2


def test_filter_contains_ignores_case(frame):
    df = frame("s string, d string", [("Andhra Pradesh", "Anantapur"), ("ANDHRA", "Guntur"), (None, "ANANTAPUR")])
    assert C.filter_contains(df, {"s": "ANDHRA", "d": "anantapur"}).count() == 1


def test_yield_of_no_area_is_zero(frame):
    df = frame("p double, a double", [(8.0, 2.0), (8.0, 0.0), (8.0, -1.0)])
    assert [r[0] for r in df.select(C.yield_per_area("p", "a")).collect()] == [4.0, 0.0, 0.0]


RAW = "State string, District string, Crop string, Rainfall string, Area string, Production string, Modal_Price string, Year string"


def test_bad_soft_field_only_leaves_the_trend(frame):
    rows = [
        ("S", "D", "C", "0.1", "2", "8", "100", "2003"),
        ("S", "D", "C", "0.3", "x", "8", "100", "2003"),
        ("S", "D", "C", "0.5", "2", "8", "100", "2003.0"),
    ]
    parsed = C.parse_agri(frame(RAW, rows))
    assert [r.trend_ok for r in parsed.collect()] == [True, False, False]
    assert parsed.agg(F.count("Rainfall")).first()[0] == 3


def test_bad_hard_field_fails(frame):
    bad = frame(RAW, [("S", "D", "C", "wet", "2", "8", "100", "2003")])
    with pytest.raises(Exception, match="unreadable number"):
        C.parse_agri(bad).collect()


@pytest.mark.parametrize("feature", list(K.SCALING))
def test_scaling_round_trip(frame, feature):
    df = frame("x double", [(0.0,), (1234.5,), (-7.25,)])
    for row in df.select("x", unscale(scale("x", feature), feature).alias("y")).collect():
        assert math.isclose(row.x, row.y, abs_tol=1e-9)


@pytest.mark.parametrize(
    "low, high, expected",
    [(2500.0, 1000.0, (1000.0, 2500.0)), (-5.0, 10.0, (0.0, 10.0)), (float("nan"), 10.0, (0.0, 10.0)), (5.0, 5.0, (5.0, 5.0))],
)
def test_order_bounds(frame, low, high, expected):
    a, b = order_bounds("a", "b")
    df = frame("a double, b double", [(low, high)]).select(a.alias("a"), b.alias("b"))
    assert tuple(df.first()) == expected
    a, b = order_bounds("a", "b")
    assert tuple(df.select(a, b).first()) == expected


def test_round_half_to_even(frame):
    df = frame("x double", [(0.125,), (0.375,), (2.5,)])
    assert [r[0] for r in df.select(round_even("x", 2)).collect()] == [0.12, 0.38, 2.5]


def test_exact_mean_does_not_depend_on_order(spark, frame):
    values = [(0.1 * i,) for i in range(1, 2000)]
    a = frame("x double", values).repartition(7).agg(exact_mean("x")).first()[0]
    b = frame("x double", values[::-1]).coalesce(1).agg(exact_mean("x")).first()[0]
    assert a == b


@pytest.mark.parametrize(
    "values, mean",
    [
        ([1e-9, 3e-9], 2e-9),
        ([2e19, 0.5], 1e19),
        ([float("inf"), 1.0], float("inf")),
        ([float("nan"), 4.0], 4.0),
        ([-1e-12, -3e-12, None], -2e-12),
        ([0.1] * 10, 0.1),
        ([8e12 + 0.25, -8e12], 0.125),
        ([None], None),
    ],
)
def test_exact_mean_keeps_every_value(frame, values, mean):
    found = frame("v double", [(v,) for v in values]).agg(exact_mean("v").alias("m")).first().m
    assert found == (mean if mean is None else pytest.approx(mean, rel=1e-15))


def test_opposite_infinities_have_no_mean(frame):
    found = frame("v double", [(float("inf"),), (float("-inf"),)]).agg(exact_mean("v").alias("m")).first().m
    assert found != found


def test_hard_check_runs_where_its_column_is_pruned(frame):
    row = ("S", "D", "C", "wet", "1", "2", "3", "2003")
    raw = frame("State string, District string, Crop string, Rainfall string, Area string, Production string, Modal_Price string, Year string", [row])
    with pytest.raises(Exception, match="unreadable number"):
        crop_trends(C.parse_agri(raw)).collect()


def test_requests_get_their_defaults(frame):
    df = C.normalise_requests(frame("req_id long, state string, district string, crop string", [(1, "assam", "cachar", "Rice")]), AS_OF)
    row = df.first()
    assert (row.state, row.district, row.crop, row.commodity) == ("ASSAM", "CACHAR", "Rice", "Rice")
    assert (row.area, row.year, row.month, row.has_rainfall) == (1.0, 2024, 6, False)


@pytest.mark.parametrize(
    "area, has_rain, rain, year, price, reason",
    [
        ("10", True, "5", "2024", "3", None),
        ("ten", True, None, "x", "y", K.BAD_AREA),
        ("10", True, None, "x", "y", K.BAD_DATE),
        ("10", True, None, "2024", "y", K.BAD_RAINFALL),
        ("10", False, None, "2024", "y", K.BAD_PRICE),
        ("10", False, None, "2024", None, None),
    ],
)
def test_first_reason_wins(frame, area, has_rain, rain, year, price, reason):
    schema = "req_id long, state string, district string, crop string, area string, has_rainfall boolean, rainfall string, year string, min_price string"
    df = frame(schema, [(1, "s", "d", "c", area, has_rain, rain, year, price)])
    assert C.validate_requests(C.normalise_requests(df, AS_OF)).first().reason == reason


def resolved(frame, has_rain, rain, low, high, known=True):
    request = frame(REQUEST, [(1, "S", "D", "C", "Rabi", "1", has_rain, rain, low, high)])
    defaults = frame(DEFAULTS, [("S", "D", "C" if known else "X", 0.5, -2.0, 0.25)])
    return C.resolve_inputs(C.validate_requests(C.normalise_requests(request, AS_OF)), defaults).first()


def test_given_values_are_clamped_then_scaled(frame):
    row = resolved(frame, True, 100.0, -50.0, 3000.0)
    assert row.min_price_raw == 0.0
    assert row.min_price_scaled == pytest.approx((0.0 - 1563.7877) / 1029.2886)
    assert row.rainfall_scaled == pytest.approx((100.0 - 782.7453) / 925.3081)


def test_default_is_clamped_raw_but_not_rescaled(frame):
    row = resolved(frame, False, None, None, None)
    assert (row.min_price_raw, row.min_price_scaled, row.has_history) == (0.0, -2.0, True)
    assert row.rainfall_raw == pytest.approx(0.5 * 925.3081 + 782.7453)


def test_unknown_key_uses_constants(frame):
    row = resolved(frame, False, None, None, None, known=False)
    assert (row.rainfall_scaled, row.min_price_scaled, row.max_price_scaled, row.has_history) == (0.0, -1.0, 1.0, False)


def test_swap_exchanges_scaled_values_too(frame):
    row = resolved(frame, False, None, 2500.0, 1000.0)
    assert (row.min_price_raw, row.max_price_raw) == (1000.0, 2500.0)
    assert row.min_price_scaled == pytest.approx((1000.0 - 1865.0167) / 1194.8210)
    assert row.max_price_scaled == pytest.approx((2500.0 - 1563.7877) / 1029.2886)


def test_standardise_uses_the_sample_deviation(frame):
    df = C.standardise(frame("x double", [(1.0,), (2.0,), (3.0,)]), "x", "z")
    assert sorted(r.z for r in df.collect()) == [-1.0, 0.0, 1.0]
