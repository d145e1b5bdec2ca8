import math

import pytest
from pyspark.sql import functions as F

from cropline.llm.queries import _held_out
from cropline.llm.rules import STATISTICS, Bound, RuleModel, _measure, _sample, fit_rules, score_quality, statistics
from tests.llm.rows import documents, empty

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, fit_rules(docs, labels.filter(~_held_out()))


def plain_score(model, text):
    measured = dict(zip(STATISTICS, _measure((text or "").encode())))
    total = model.intercept
    for rule, weight in zip(model.rules, model.weights):
        if all((measured[b.name] > b.threshold) == b.above for b in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_held_out_documents(fitted):
    docs, labels, model = fitted
    assert 3 <= len(model.rules) <= 80 and all(model.weights)
    found = score_quality(docs, model).join(labels.filter(_held_out()), F.col("_id") == F.col("doc_id")).collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert len(good) > 700 and len(bad) > 100
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted for r in bad) <= 0.05 * len(bad)
    better = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad)
    assert better >= 0.99 * len(good) * len(bad)


def test_columns_hold_the_same_rules(fitted, spark):
    docs, _, model = fitted
    some = docs.limit(500).select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    want = sorted((r.doc_id is None, r.doc_id or 0, round(plain_score(model, r.text), 9)) for r in some.collect())
    got = sorted((r._id is None, r._id or 0, round(r.score, 9)) for r in score_quality(some, model).collect())
    assert got == want


def test_statistics_of_known_texts(spark):
    rows = [("Aa bb bb é9!\nx, $$",), (None,), ("",)]
    measured = statistics(spark.createDataFrame(rows, "text string"), "text").collect()
    assert measured[0].asDict() == pytest.approx(
        dict(letters=8 / 13, capitals=1 / 8, digits=1 / 13, stops=1 / 6, marks=3 / 6, word_length=13 / 6, line_words=3.0, distinct=5 / 6, repeats=1 / 6)
    )
    assert measured[1] == measured[2] and not any(measured[1])


def test_many_rows_on_few_ids_stay_within_the_bound(spark):
    docs = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (0, None), (None, 1)], "doc_id long, quality int")
    assert _sample(docs, labels, "doc_id", "text", 100).count() == 100
    assert fit_rules(docs, labels, training=100).score() is not None


def test_odd_documents_and_labels(spark):
    docs = documents(spark)
    model = RuleModel((((Bound("letters", True, 0.5)),),), (2.0,), -1.0, None)
    got = score_quality(docs, model)
    assert got.columns == ["_id", "score", "predicted"] and got.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())
    assert score_quality(empty(spark), model).count() == 0
    schema = "doc_id long, quality int, toxic int"
    for rows, want in (([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)):
        constant = fit_rules(docs, spark.createDataFrame(rows, schema))
        assert {r.score for r in score_quality(docs, constant).collect()} == {want}
