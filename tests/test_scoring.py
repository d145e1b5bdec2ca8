from datetime import date

import pytest
from pyspark.sql import functions as F

from cropline.operators import scoring as M
from cropline.plans.artefacts import build_artefacts, derive_artefacts, fit_vocabulary, load_artefacts
from cropline.plans.prediction import predict, published
from cropline.session import materialise
from cropline.sources.files import append_predictions, read_log

AS_OF = date(2024, 6, 15)
TRENDS = "State string, District string, Crop string, year int, yield double, price double"
KEYED = "req_id long, state string, district string, crop string, area double, predicted_yield double, predicted_price double"


def history(frame, rows, trends=()):
    known = materialise(frame(TRENDS, list(trends)))
    found = M.history_or_synthetic(frame(KEYED, rows), known).collect()
    return {r.req_id: [tuple(p) for p in r.historical_trend] for r in found}


def test_synthetic_history(frame):
    found = history(frame, [(1, "S", "D", "C", 10.0, 8.0, 100.0), (2, "S", "D", "C", 0.0, 8.0, 100.0)])
    assert found[1] == [(2020, 0.704, 90.0), (2021, 0.752, 93.0), (2022, 0.72, 96.0), (2023, 0.84, 103.0), (2024, 0.8, 100.0)]
    assert found[2][-1] == (2024, 0.2, 100.0)


def test_known_history_by_year(frame):
    trends = [("S", "D", "C", 2005, 2.0, 20.0), ("S", "D", "C", 2001, 1.0, 10.0)]
    found = history(frame, [(1, "S", "D", "C", 1.0, 1.0, 1.0)], trends)
    assert found[1] == [(2001, 1.0, 10.0), (2005, 2.0, 20.0)]


def test_revenue_counts_ten_quintals_per_tonne(frame):
    assert M.valuation(frame(KEYED, [(1, "S", "D", "C", 1.0, 2.5, 100.0)])).first().total_value == 2500.0


def test_failed_rows_are_logged_with_zeros_and_rejected_ones_not(frame):
    rows = [
        (1, "S", "D", "C", 1.0, 2.0, 3.0, 60.0, None, None),
        (2, "S", "D", "C", 1.0, None, None, None, "no area", None),
        (3, "S", "D", "C", 1.0, None, None, None, None, "model missing"),
    ]
    df = frame(KEYED + ", total_value double, reason string, error string", rows)
    logged = {r.req_id: (r.predicted_yield, r.total_value, r.status) for r in M.prediction_log_rows(df).collect()}
    assert logged == {1: (2.0, 60.0, "SUCCESS"), 3: (0.0, 0.0, "ERROR: model missing")}
    assert [tuple(r) for r in M.rejected_requests(df).collect()] == [(2, "no area")]


@pytest.fixture(scope="module")
def world(spark):
    ids = spark.range(400).withColumn("i", F.col("id").cast("int"))
    state = F.when(F.col("i") % 3 == 0, "ASSAM").when(F.col("i") % 3 == 1, "KERALA").otherwise("BIHAR")
    crop = F.when(F.col("i") % 2 == 0, "Rice").otherwise("Pump Kin")
    agri = ids.select(
        state.alias("State"), F.concat(F.lit("D"), (F.col("i") % 5).cast("string")).alias("District"),
        (2000 + F.col("i") % 4).alias("Year"), F.lit("Autumn     ").alias("Season"), crop.alias("Crop"),
        (1.0 + F.col("i") % 7).alias("Area"), ((1.0 + F.col("i") % 7) * 3).alias("Production"),
        F.lit("X").alias("SUBDIVISION"), (F.col("i") % 11 / 5 - 1).alias("Rainfall"), (1000.0 + F.col("i") % 13).alias("Modal_Price"),
        F.lit(-0.5).alias("Min_Price"), F.lit(0.5).alias("Max_Price"),
    )
    prices = ids.select(
        state.alias("State"), F.concat(F.lit("D"), (F.col("i") % 5).cast("string")).alias("District"),
        F.concat(F.lit("D"), (F.col("i") % 5).cast("string"), F.lit(" Mandi")).alias("Market"), crop.alias("Commodity"),
        F.lit("Local").alias("Variety"), F.when(F.col("i") % 2 == 0, "FAQ").otherwise("Large").alias("Grade"),
        (2000 + F.col("i") % 4).alias("Year"), (1 + F.col("i") % 12).alias("Month"),
        (900.0 + F.col("i") % 50).alias("Min_Price"), (1100.0 + F.col("i") % 50).alias("Max_Price"), (1000.0 + F.col("i") % 50).alias("Modal_Price"),
    )
    return agri, prices, derive_artefacts(agri, fit_vocabulary(agri, prices))


REQUEST = "req_id long, state string, district string, crop string, season string, area string"
REQUESTS = [
    (1, "assam", "d0", "Rice", "Autumn", "10"),
    (2, "Kerala", "d1", "Pump Kin", "Kharif", "10"),
    (3, "kerala", "d1", "Rice", "Autumn", "ten"),
]


def test_models_fit_and_predict(world, frame, tmp_path):
    agri, prices, artefacts = world
    trees = {"maxIter": 3, "maxDepth": 3}
    yields = M.fit_yield(agri, artefacts.production_vocab, **trees)
    costs = M.fit_price(prices, artefacts.price_vocab, **trees)
    df = predict(frame(REQUEST, REQUESTS), artefacts, AS_OF, yields, costs)
    rows = {r.req_id: r for r in df.collect()}
    assert rows[1].predicted_yield == 30.0 and rows[1].yield_level == 1
    assert rows[2].predicted_yield > 0 and 900 < rows[2].predicted_price < 1100
    assert rows[3].reason and rows[3].predicted_yield is None
    assert rows[2].market == "D1 Mandi" and rows[2].grade == "FAQ" and rows[2].variety == "Local"
    shown = {r.req_id: r for r in published(df).collect()}
    assert set(shown) == {1, 2}
    assert shown[1].confidence_rating == "HIGH" and len(shown[1].historical_trend) > 0
    assert shown[1].total_estimated_value_inr == pytest.approx(rows[1].total_value, abs=0.01)

    log = M.prediction_log_rows(df).withColumns({"id": F.col("req_id"), "username": F.lit("ada")})
    append_predictions(log, str(tmp_path / "log"))
    append_predictions(log, str(tmp_path / "log"))
    # Rejected requests are answered and not logged.
    stored = read_log(df.sparkSession, str(tmp_path / "log"))
    assert stored.count() == 4 and stored.filter("status <> 'SUCCESS'").count() == 0
    assert [r.req_id for r in M.rejected_requests(df).collect()] == [3]


def test_training_fit_explains_something(world):
    agri, _, artefacts = world
    from cropline.operators.stats import r2

    model = M.fit_yield(agri, artefacts.production_vocab, maxIter=3, maxDepth=3)
    scored = M.score_yield(M.yield_training_rows(agri, artefacts.production_vocab), model)
    assert r2(scored, "Production", "predicted_yield").first().r2 > 0.8


def test_without_models_yield_comes_from_history(world, frame):
    _, _, artefacts = world
    df = frame(REQUEST + ", given_price double", [(*r, 100.0) for r in REQUESTS])
    rows = {r.req_id: r for r in predict(df, artefacts, AS_OF).collect()}
    assert rows[2].predicted_yield == 30.0 and rows[2].total_value == 30.0 * 100.0 * 10


def test_stored_artefacts_read_back(world, tmp_path, spark):
    agri, prices, derived = world
    root = str(tmp_path / "artefacts")
    built = build_artefacts(agri, root, "7", derived.vocab)
    again = load_artefacts(spark, root, "7")
    for name in ("state_districts", "district_crops", "defaults", "trends", "vocab"):
        expected = sorted(map(str, getattr(derived, name).collect()))
        assert sorted(map(str, getattr(built, name).collect())) == expected
        assert sorted(map(str, getattr(again, name).collect())) == expected
