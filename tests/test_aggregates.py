import random

import pytest
from pyspark.sql import functions as F

from cropline.operators import aggregates as A
from cropline.operators.keyed import insert_if_absent
from cropline.session import materialise

AGRI = "State string, District string, Year int, Crop string, Area double, Production double, Rainfall double, Modal_Price double, Min_Price double, Max_Price double"
DEFAULTS = "State string, District string, Crop string, rainfall double, min_price double, max_price double"
TRENDS = "State string, District string, Crop string, year int, yield double, price double"


@pytest.fixture(scope="module")
def agri(frame):
    rng = random.Random(3)
    rows = [
        (rng.choice("AB"), rng.choice("de"), rng.choice([2001, 2002, 2003]), rng.choice(["Rice", "Gram"]),
         rng.choice([0.0, 2.0, 7.0]), round(rng.uniform(1, 99), 2), rng.gauss(0, 1), round(rng.uniform(500, 900), 2),
         rng.gauss(0, 1), rng.gauss(0, 1))
        for _ in range(300)
    ]
    return frame(AGRI, rows)


def as_set(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def test_lists_are_sorted(agri):
    assert A.state_districts(agri).filter("State = 'A'").first().districts == ["d", "e"]
    assert all(r.crops == ["Gram", "Rice"] for r in A.district_crops(agri).collect())


def test_rollup_gives_the_same_tables(agri):
    yearly = A.yearly_rollup(agri)
    assert as_set(A.rollup_trends(yearly)) == as_set(A.crop_trends(agri))
    assert as_set(A.rollup_defaults(yearly)) == as_set(A.crop_defaults(agri))


def test_rows_outside_trends_still_count_in_defaults(frame):
    rows = [("A", "d", 2001, "Rice", 2.0, 8.0, 1.0, 100.0, 0.0, 0.0, True), ("A", "d", None, "Rice", 2.0, 8.0, 3.0, 100.0, 0.0, 0.0, False)]
    df = frame(AGRI + ", trend_ok boolean", rows)
    yearly = A.yearly_rollup(df)
    assert A.rollup_defaults(yearly).first().rainfall == 2.0
    assert [tuple(r)[3:] for r in A.rollup_trends(yearly).collect()] == [(2001, 4.0, 100.0)]


def test_trend_is_nested_by_year(agri):
    for row in A.nest_trends(A.crop_trends(agri)).collect():
        assert [p.year for p in row.historical_trend] == sorted(p.year for p in row.historical_trend)


def test_unknown_key_averages_groups_of_state_or_crop(frame):
    rng = random.Random(5)
    known = [(s, d, c, round(rng.gauss(0, 1), 4), round(rng.gauss(0, 1), 4), round(rng.gauss(0, 1), 4))
             for s in "AB" for d in "de" for c in ("Rice", "Gram", "Jute") if rng.random() < 0.8]
    defaults = materialise(frame(DEFAULTS, known))
    keys = [(i, s, d, c) for i, (s, d, c) in enumerate((s, d, c) for s in "ABZ" for d in "def" for c in ("Rice", "Gram", "Okra"))]
    found = A.defaults_with_fallback(frame("req_id long, state string, district string, crop string", keys), defaults)
    table = {k[:3]: k[3:] for k in known}
    for row in found.collect():
        near = [v for (s, _, c), v in table.items() if s == row.state or c == row.crop]
        if (row.state, row.district, row.crop) in table:
            expected = table[row.state, row.district, row.crop]
        elif near:
            expected = tuple(sum(v[i] for v in near) / len(near) for i in range(3))
        else:
            expected = (0.0, -1.0, 1.0)
        assert (row.rainfall, row.min_price, row.max_price) == pytest.approx(expected, abs=5.1e-5)


def test_cold_start_ladder(frame):
    trends = materialise(frame(TRENDS, [
        ("A", "D", "Rice", 2001, 2.0, 1.0), ("A", "D", "Rice", 2002, 4.0, 1.0), ("A", "E", "Rice", 2001, 9.0, 1.0),
        ("B", "D", "Jute", 2001, 7.0, 1.0),
    ]))
    keys = [(1, "a ", " d", "Rice", 10.0), (2, "A", "Z", "Rice", 10.0), (3, "A", "D", "Jute", 10.0), (4, "A", "D", "Okra", 10.0),
            (5, "A", "D", "rice", 10.0), (6, "A", "D", "Rice", -1.0)]
    df = A.fallback_yield(frame("req_id long, state string, district string, crop string, area double", keys), trends, ("A",))
    found = {r.req_id: (r.yield_level, r.predicted_yield) for r in df.collect()}
    assert found == {1: (1, 30.0), 2: (2, 50.0), 3: (3, 70.0), 4: (4, 5.0), 5: (4, 5.0), 6: (1, 0.0)}


def test_other_states_are_left_alone(frame):
    trends = materialise(frame(TRENDS, [("A", "D", "Rice", 2001, 2.0, 1.0)]))
    key = frame("req_id long, state string, district string, crop string, area double", [(1, "B", "D", "Rice", 1.0)])
    assert A.fallback_yield(key, trends, ("A",)).first().predicted_yield is None


def test_price_grains_equal_separate_group_bys(frame):
    rng = random.Random(9)
    pick = lambda *options: rng.choice(options)
    rows = [(pick("d", "e", None), pick(2001, 2002, None), pick("rice", "jute", None), pick(10.5, 20.25, None), 30.0, pick(7.0, float("nan"))) for _ in range(200)]
    prices = frame("District string, Year int, Commodity string, Min_Price double, Max_Price double, Modal_Price double", rows)
    found = A.price_means(prices)
    for level, keys in ((1, ["District", "Year", "Commodity"]), (2, ["Year", "Commodity"]), (3, ["Commodity"])):
        plain = prices.na.drop(subset=keys).groupBy(*keys).agg(
            F.avg("Min_Price").alias("Min_Price"), F.avg(F.when(~F.isnan("Modal_Price"), F.col("Modal_Price"))).alias("Modal_Price")
        )
        a = sorted(map(tuple, found.filter(F.col("level") == level).select(*keys, "Min_Price", "Modal_Price").collect()), key=str)
        b = sorted(map(tuple, plain.collect()), key=str)
        assert a == pytest.approx(b) if not a else [x[:-2] for x in a] == [x[:-2] for x in b]
        for x, y in zip(a, b):
            assert x[-2:] == pytest.approx(y[-2:])


def test_insert_keeps_existing_and_one_new_row(frame):
    existing = frame("id long, username string", [(1, "ada")])
    incoming = frame("id long, username string", [(9, "ada"), (8, "bob"), (7, "bob"), (6, "eve")])
    rows = {tuple(r) for r in insert_if_absent(existing, incoming, "username", ["id"]).collect()}
    assert rows == {(1, "ada"), (7, "bob"), (6, "eve")}


def test_shape_and_group_counts(agri):
    assert A.shape(agri) == (300, 10)
    assert sum(r["rows"] for r in A.group_counts(agri, ["State"]).collect()) == 300
