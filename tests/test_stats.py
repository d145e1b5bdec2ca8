import random

import pytest
from pyspark.sql import functions as F

from cropline.operators import stats as S

# Modal price with scaled minimum and maximum.
SEED = [
    (657.0570571, -1.364624513, -1.402751655), (1621.850789, 0.00619836, -0.048399435),
    (1615.921569, 0.020123454, -0.089598506), (1888.594595, 0.214033785, 0.136481557),
    (2060.809935, 0.3965723, 0.278497845), (2454.607843, 0.688519644, 0.630850917),
    (2501.700441, 0.77625316, 0.637511106), (2850.833333, 1.076022253, 0.918379923),
]


@pytest.fixture(scope="module")
def seed(frame):
    return frame("Modal_Price double, Min_Price double, Max_Price double", SEED)


def test_seed_prices_correlate(seed):
    for row in S.correlations(seed, [("Modal_Price", "Min_Price"), ("Modal_Price", "Max_Price")]).collect():
        assert row.correlation > 0.95


def test_seed_fit_is_a_scale(seed):
    row = S.fit_scale(seed, "Min_Price", "Modal_Price").first()
    assert 800 < row.slope < 1000 and 1500 < row.intercept < 1800 and row.r2 > 0.95


def test_constant_column_has_no_correlation(frame):
    df = frame("t double, c double, u double", [(1.0, 5.0, 2.0), (2.0, 5.0, 1.0), (4.0, 5.0, 1.5)])
    assert S.correlations(df, [("t", "c")]).first().correlation is None
    ranked = S.rank_correlations(df, "t", ["c", "u"]).orderBy("rank").collect()
    assert [(r["rank"], r.column) for r in ranked] == [(1, "u"), (2, "c")]


def test_nulls_are_dropped_pairwise(frame):
    df = frame("x double, y double, z double", [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, float("nan"), 5.0), (4.0, 8.0, 2.0)])
    found = {(r.x, r.y): r.correlation for r in S.correlations(df, [("x", "y"), ("x", "z")]).collect()}
    assert found["x", "y"] == pytest.approx(1.0)
    assert found["x", "z"] == pytest.approx(0.2401922, abs=1e-6)


def test_fit_needs_enough_rows(frame):
    five = frame("x double, y double", [(float(i), 2.0 * i) for i in range(5)])
    assert S.fit_scale(five, "x", "y").count() == 0
    assert S.fit_scale(five.union(five.limit(1)), "x", "y").first().n == 6


def test_row_count_is_judged_on_joined_rows(frame):
    df = frame("x double, y double", [(float(i), 2.0 * i if i < 4 else None) for i in range(11)])
    assert S.fit_scale(df, "x", "y", min_rows=10, count_pairs=False).first().n == 4


def test_constant_target_has_no_r2(frame):
    df = frame("x double, y double", [(float(i), 3.0) for i in range(8)])
    row = S.fit_scale(df, "x", "y").first()
    assert (row.slope, row.intercept, row.r2) == (0.0, 3.0, None)
    assert S.r2(df, "y", "x").first().r2 is None


def test_best_column_takes_the_first_of_equals(frame):
    rows = [("Rabi ", float(i), float(i), float(i), "x") for i in range(9)]
    df = frame("Season string, Rainfall double, JF double, MAM double, JJAS string", rows)
    row = S.best_rain_column(df, ["JF", "MAM", "JJAS"]).first()
    assert (row.Season, row.column) == ("Rabi", "JF")
    assert S.fit_best_rain(df, ["JF", "MAM", "JJAS"]).first().slope == pytest.approx(1.0)


def test_describe(frame):
    import pandas as pd

    rng = random.Random(1)
    values = [rng.gauss(0, 5) for _ in range(501)]
    found = dict(S.describe(frame("x double", [(v,) for v in values]), "x").collect())
    for name, value in pd.Series(values).describe().items():
        assert found[name] == pytest.approx(value)


def test_column_stats_skips_missing_columns(seed):
    rows = {r.column: r for r in S.column_stats(seed, ["Rainfall", "Min_Price"]).collect()}
    assert list(rows) == ["Min_Price"] and rows["Min_Price"].max == 1.076022253


def test_sample_pairs_keeps_the_first_of_each_pair(spark):
    df = spark.range(700).select(
        F.lit("Rabi").alias("Season"), (2000 + F.col("id") % 7).cast("int").alias("Year"),
        F.lit("S").alias("sub_clean"), F.col("id"),
    )
    rows = sorted(map(tuple, S.sample_pairs(df, ["Year", "sub_clean", "id"]).select("sample", "Year", "id").collect()))
    assert rows == [(i + 1, 2000 + y, (y)) for i, y in enumerate(range(5))]


def test_distinct_head(frame):
    assert [r[0] for r in S.distinct_head(frame("s string", [("c",), ("a",), ("a",), ("b",)]), "s", 2).collect()] == ["a", "b"]


FACTS = "State string, District string, Season string, Year int, SUBDIVISION string, Rainfall double, Min_Price double, Max_Price double"


def test_moments_by_key_equal_the_joined_rows(spark, frame):
    rng = random.Random(4)
    rows = [
        (f"S{i % 3} ", f"d{i % 5}", ["Rabi ", "Kharif"][i % 2], 2000 + i % 4, f" r{i % 6}",
         None if i % 17 == 0 else float("nan") if i % 19 == 0 else rng.gauss(0, 1), rng.gauss(0, 1), None if i % 7 == 0 else rng.gauss(0, 1))
        for i in range(400)
    ]
    facts = frame(FACTS, rows)
    rain = frame(
        "SUBDIVISION string, YEAR int, JF double, MAM double, JJAS double",
        [(f"R{k}", y, rng.random() * 900, 5.0, None if y == 2001 else rng.random()) for k in range(5) for y in range(2000, 2004)],
    )
    joined, cols = S.join_rainfall(facts, rain), ["JF", "MAM", "JJAS"]
    fast = {r.column: r for r in S.rank_rainfall(facts, rain, cols).collect()}
    for row in S.rank_correlations(joined, "Rainfall", cols).collect():
        assert fast[row.column]["rank"] == row["rank"]
        assert fast[row.column].correlation == (None if row.correlation is None else pytest.approx(row.correlation, abs=1e-12))
    assert fast["MAM"].correlation is None
    slow = {r.Season: r for r in S.fit_best_rain(joined, cols, 0).collect()}
    for row in S.best_rainfall(facts, rain, cols).collect():
        want = slow[row.Season]
        assert (row.column, row.n) == (want.column, want.n)
        assert [row.slope, row.intercept, row.r2] == pytest.approx([want.slope, want.intercept, want.r2], rel=1e-9)
    means = frame("State string, District string, Year int, Min_Price double, Max_Price double",
                  [(f"S{i}", f"D{j}", y, 100.0 * i + j + y % 7, 50.0 * j - y % 3) for i in range(3) for j in range(5) for y in range(2000, 2003)])
    priced = S.join_prices(facts, means)
    for row in S.fit_price_scale(facts, means).collect():
        want = S.fit_scale(priced, f"{row.price}_x", f"{row.price}_y", min_rows=10, count_pairs=False).first()
        assert row.n == want.n
        assert [row.slope, row.intercept, row.r2] == pytest.approx([want.slope, want.intercept, want.r2], rel=1e-9, abs=1e-9)


def test_small_side_is_broadcast(spark, frame, capsys):
    facts = frame(FACTS, [("S", "d", "Rabi", 2000, "R", 1.0, 1.0, 1.0)])
    rain = frame("SUBDIVISION string, YEAR int, JF double", [("R", 2000, 1.0)])
    S.join_rainfall(facts, rain).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out
