import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from cropline.operators import scoring as M
from cropline.operators.aggregates import category_values, vocabulary
from cropline.plans import models as P
from cropline.plans.artefacts import PRICE_VOCABULARY, YIELD_VOCABULARY

AGRI = "State string, District string, Year int, Season string, Crop string, Area double, Production double, Rainfall double, SUBDIVISION string, Modal_Price double, Min_Price double, Max_Price double"
PRICES = "State string, District string, Market string, Commodity string, Variety string, Grade string, month int, year int, Min_Price double, Max_Price double, Modal_Price double"


@pytest.fixture
def inputs(frame):
    agri = frame(AGRI, [("S" + str(i % 3), "D", 2000 + i, "Rabi", "C" + str(i % 2), 1.0 + i, 3.0 * i, 0.1, "X", 10.0, 1.0, 2.0) for i in range(40)])
    prices = frame(PRICES, [("S", "D" + str(i % 4), "M", "C", "V", "G", 1, 2003, 100.0 + i, 200.0 + i, 150.0 + i) for i in range(40)])
    values = category_values(agri, YIELD_VOCABULARY, "production").unionByName(category_values(prices, PRICE_VOCABULARY, "price"))
    return agri, prices, vocabulary(values).cache()


def test_loaded_models_score_as_the_fitted_ones(spark, inputs, tmp_path):
    agri, prices, vocab = inputs
    own = {name: vocab.filter(F.col("model") == name) for name in ("production", "price")}
    fitted = P.Models(M.fit_yield(agri, own["production"], maxIter=3), M.fit_price(prices, own["price"], maxIter=3))
    P.save_models(fitted, vocab, str(tmp_path), "7")
    loaded = P.load_models(spark, vocab, str(tmp_path), "7")
    rows = M.yield_training_rows(agri, own["production"])
    scores = [[r.predicted_yield for r in M.score_yield(rows, m.yields).orderBy("Year").collect()] for m in (fitted, loaded)]
    assert scores[0] == scores[1] and len(set(scores[0])) > 3
    rows = M.price_training_rows(prices, own["price"])
    scores = [[r.predicted_price for r in M.score_price(rows, m.prices).orderBy("Min_Price").collect()] for m in (fitted, loaded)]
    assert scores[0] == scores[1]
    # Saving again replaces the models.
    P.save_models(loaded, vocab, str(tmp_path), "7")
    P.load_models(spark, vocab, str(tmp_path), "7")


def test_another_vocabulary_or_order_is_refused(spark, inputs, tmp_path, monkeypatch):
    vocab = inputs[2]
    tree = SQLTransformer(statement="SELECT *, 1.0 AS prediction FROM __THIS__")
    P.save_models(P.Models(tree, tree), vocab, str(tmp_path), "1")
    shifted = vocab.withColumn("ordinal", F.when(F.col("model") == "price", F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    with pytest.raises(ValueError, match="price model of version 1 was fitted with another vocabulary"):
        P.load_models(spark, shifted, str(tmp_path), "1")
    with pytest.raises(ValueError, match="yield model .* another vocabulary"):
        P.load_models(spark, vocab.filter("value <> 'C1'"), str(tmp_path), "1")
    monkeypatch.setitem(P.KINDS, "yield", (["area", *M.YIELD_FEATURES[:3]], "production"))
    with pytest.raises(ValueError, match="yield model of version 1 takes"):
        P.load_models(spark, vocab, str(tmp_path), "1")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        P.load_models(spark, vocab, str(tmp_path), "2")
