import random

import pytest

from cropline.functions import texts as X
from cropline.functions.constants import SCALING
from cropline.operators import insights as I

PRED = (
    "req_id long, state string, district string, crop string, season string, area double,"
    " predicted_yield_tonnes double, predicted_price_inr_quintal double, total_estimated_value_inr double,"
    " market string, variety string, grade string, min_price double, max_price double, rainfall double"
)


def row(area=10.0, z=0.0, price=1000.0, low=900.0, high=1100.0, rain=None):
    mean, std = SCALING["rainfall"]
    return (1, "S", "D", "Rice", "Rabi", area, 8.0, price, price * 80, "M", "V", "FAQ", low, high, rain if rain is not None else z * std + mean)


@pytest.mark.parametrize(
    "area, z, weights",
    [(20.0, 3.0, (58, 28, 14)), (1.0, 0.0, (49, 18, 33)), (float("nan"), 1.0, (60, 30, 10)), (0.0, 1.0, (60, 30, 10)), (-5.0, 0.0, (42, 18, 40))],
)
def test_weights(frame, area, z, weights):
    found = I.influence_weights(frame(PRED, [row(area, z)])).first()
    assert (found.area_weight, found.rain_weight, found.base_weight) == weights


def test_weights_always_add_up(frame):
    rng = random.Random(2)
    df = frame(PRED, [row(rng.uniform(-10, 60), rng.gauss(0, 2)) for _ in range(200)])
    for r in I.influence_labels(I.influence_weights(df)).collect():
        assert r.area_weight + r.rain_weight + r.base_weight == 100
        assert r.area_influence in (X.VERY_HIGH, X.HIGH, X.MODERATE)


@pytest.mark.parametrize("z, kind", [(-0.3, X.NORMAL), (-0.31, X.BELOW), (0.3, X.NORMAL), (0.31, X.ABOVE)])
def test_rainfall_class(frame, z, kind):
    assert frame("z double", [(z,)]).select(I.rainfall_class("z")).first()[0] == kind


@pytest.mark.parametrize("price, label", [(1050.0, X.STABLE), (1051.0, X.INCREASING), (950.0, X.STABLE), (949.0, X.DECREASING)])
def test_market_trend(frame, price, label):
    assert I.market_trend(frame(PRED, [row(price=price)])).first().market_trend == label


def test_bounds(frame):
    r = I.confidence_bounds(frame(PRED, [row(price=-10.0)])).first()
    assert (r.price_low, r.price_high) == (0.0, 0.0) and r.revenue_low == pytest.approx(-704.0)


def test_sentences(frame):
    df = frame(PRED, [row(area=2.5, rain=100.0)])
    plain = I.narratives(df).first()
    assert plain.rainfall_narrative.startswith("Expected seasonal rainfall of 100.0 mm is below")
    assert "**Farm Size of 2.5 Hectares**" in plain.explanation and "(below average rainfall)" in plain.explanation
    technical = I.narratives(df, "technical").first().explanation
    assert "**51%** of the yield" in technical and "Z-score index: -0.7379" in technical and technical.endswith("**22%** soil and climate baseline.")


def test_report_lists_every_attribute(frame):
    rows = {r.attribute: r.value for r in I.valuation_report(frame(PRED, [row()])).collect()}
    assert rows["Predicted Crop Yield"] == "8.00 Tonnes" and rows["Expected Yearly Revenue"] == "₹80,000.00"
    assert rows["Land Area Profile"] == "10 Hectares" and rows["Expected Price Range"] == "₹880.00 – ₹1120.00 per Quintal"
    technical = I.valuation_report(frame(PRED, [row()]), "technical")
    assert {r.attribute for r in technical.collect()} >= {"Rainfall Standard Index", "Price Model Min Spec (Scaled)"}


TRENDS = "State string, District string, Crop string, year int, yield double, price double"


def test_series_are_stretched(frame):
    df = frame(TRENDS, [("S", "D", "C", 2001, 2.0, 5.0), ("S", "D", "C", 2002, 4.0, 5.0), ("S", "D", "C", 2003, 3.0, 5.0)])
    rows = {r.year: (r.yield_norm, r.price_norm) for r in I.normalise_series(df).collect()}
    assert rows == {2001: (0.0, 0.0), 2002: (1.0, 0.0), 2003: (0.5, 0.0)}
    ends = I.trend_endpoints(df).first()
    assert (ends.first_year, ends.first_yield, ends.last_year, ends.last_yield) == (2001, 2.0, 2003, 3.0)
