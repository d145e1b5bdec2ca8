import pytest

from cropline import schemas
from cropline.operators import align as L
from cropline.operators.aggregates import price_means
from cropline.session import materialise

PRICES = "State string, District string, Year int, Commodity string, Min_Price double, Max_Price double, Modal_Price double"
TARGET = "District string, Year int, Crop string"
RAIN = "SUBDIVISION string, YEAR int, JF double, MAM double, JJAS double, OND double, ANNUAL double"


def ladder(frame, prices, targets, **options):
    rows = [("ASSAM", *p) for p in prices]
    means = materialise(price_means(frame(PRICES, rows)))
    found = L.price_fallback(frame(TARGET, targets), means, **options).collect()
    return {(r.District, r.Year, r.Crop): (r.level, r.Min_Price, r.Max_Price, r.Modal_Price) for r in found}


MARKET = [
    ("D", 2003, "rice(fine)", 1.0, 2.0, 3.0),
    ("D", 2003, "boiled rice", 10.0, 20.0, 30.0),
    ("E", 2003, "paddy", 100.0, 200.0, 300.0),
    ("E", 2004, "jute", 7.0, 8.0, 9.0),
]


def test_four_levels(frame):
    found = ladder(frame, MARKET, [("D", 2003, "Rice"), ("F", 2003, "Rice"), ("F", 1999, "Jute"), ("D", 2003, "Okra")])
    assert found["D", 2003, "Rice"] == (1, 10.0, 20.0, 30.0)
    assert found["F", 2003, "Rice"] == (2, 100.0, 200.0, 300.0)
    assert found["F", 1999, "Jute"] == (3, 7.0, 8.0, 9.0)
    assert found["D", 2003, "Okra"] == (4, 1800.0, 2200.0, 2000.0)


def test_first_match_wins_even_without_a_mean(frame):
    market = [("D", 2003, "jute", None, 2.0, 3.0), ("E", 2003, "jute", 5.0, 5.0, 5.0)]
    assert ladder(frame, market, [("D", 2003, "Jute")])["D", 2003, "Jute"] == (1, None, 2.0, 3.0)


def test_alias_order_precedes_name_order(frame):
    market = [("D", 2003, "black gram", 1.0, 1.0, 1.0), ("D", 2003, "urad", 2.0, 2.0, 2.0)]
    found = ladder(frame, market, [("D", 2003, "Blackgram"), ("D", 2003, "Urad")])
    assert found["D", 2003, "Blackgram"][1] == 1.0 and found["D", 2003, "Urad"][1] == 2.0


def test_unmapped_crop_is_a_pattern(frame):
    market = [("D", 2003, "xy", 1.0, 1.0, 1.0), ("D", 2003, "x(y)", 2.0, 2.0, 2.0)]
    assert ladder(frame, market, [("D", 2003, "X(Y)")])["D", 2003, "X(Y)"][1] == 1.0
    assert ladder(frame, market, [("D", 2003, "X(Y)")], literal=True)["D", 2003, "X(Y)"][1] == 2.0


def test_no_market_rows_at_all(frame):
    assert ladder(frame, [], [("D", 2003, "Rice")])["D", 2003, "Rice"] == (4, 1800.0, 2200.0, 2000.0)


def test_alias_expansion(frame):
    rows = L.expand_aliases(frame("Crop string", [("Wheat",), ("Okra",)])).collect()
    assert {(r.Crop, r.priority, r.alias) for r in rows} == {
        ("Wheat", 0, "wheat"), ("Wheat", 1, "atta"), ("Wheat", 2, "maida"), ("Okra", 0, "okra")
    }


@pytest.fixture(scope="module")
def rain(frame):
    return frame(RAIN, [("S", 2001, 1.0, 2.0, 3.0, None, 10.0), ("S", 2002, 3.0, 4.0, 5.0, 8.0, 30.0), ("S", 2003, None, 6.0, 7.0, float("nan"), 20.0)])


@pytest.mark.parametrize(
    "year, season, expected",
    [(2001, "Kharif", 3.0), (2001, "Rabi", 8.0), (2003, "Winter", 2.0), (1990, "Summer", 4.0), (2002, "Monsoon", 30.0),
     (1990, "Whole Year", 20.0), (2002, "Autumn", 8.0), (2003, "Rabi", 8.0)],
)
def test_rain_of_the_season_or_its_mean(frame, rain, year, season, expected):
    assert L.rainfall_for(frame("Year int, Season string", [(year, season)]), rain).first().rain_mm == expected


def test_a_year_twice_fails(frame, rain):
    with pytest.raises(Exception, match="year twice"):
        L.rainfall_for(frame("Year int, Season string", [(2001, "Rabi")]), rain.union(rain)).collect()


def test_replace_state(frame):
    base = frame("State string, v long", [("ASSAM", 1), ("assam", 2), (" ASSAM", 3), (None, 4), ("BIHAR", 5)])
    new = frame("State string, extra string", [("ASSAM", "x")])
    rows = {(r.State, r.v, r.extra) for r in L.replace_state(base, new, "ASSAM").collect()}
    assert rows == {(" ASSAM", 3, None), (None, 4, None), ("BIHAR", 5, None), ("ASSAM", None, "x")}


def test_align_state(frame, rain):
    production = frame(
        "State_Name string, District_Name string, Crop_Year int, Season string, Crop string, Area double, Production double",
        [(" assam", "d ", 2003, "Kharif ", "Rice ", 2.0, 8.0), ("Bihar", "d", 2003, "Kharif", "Rice", 2.0, 8.0)],
    )
    prices = frame(PRICES, [("Assam ", "d", 2003, " Paddy", 1000.0, 2000.0, 1500.0)])
    df = L.align_state(production, prices, rain, "ASSAM", "S")
    assert df.columns == schemas.AGRI.names
    row = df.first()
    assert df.count() == 1
    assert (row.State, row.District, row.Season, row.Crop, row.SUBDIVISION) == ("ASSAM", "D", "Kharif", "Rice", "S")
    assert row.Modal_Price == 1500.0
    assert row.Min_Price == pytest.approx((1000.0 - 1563.7877) / 1029.2886)
    assert row.Rainfall == pytest.approx((7.0 - 782.7453) / 925.3081)
