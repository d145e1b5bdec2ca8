import numpy as np
from pyspark.sql import functions as F

from cropline.llm import toxicity
from cropline.llm.toxicity import Matcher, Model, _fit, _starts, drop_toxic, fit_severity, score_severity
from tests.llm.rows import documents, empty

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    model = fit_severity(docs, labels.filter(~held), training=2500)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 2
    found = score_severity(docs, model).join(labels.filter(held), F.col("_id") == F.col("doc_id")).cache()
    count = {(r.toxic, r.rejected): r["count"] for r in found.groupBy("toxic", "rejected").count().collect()}
    assert count[1, True] >= 0.85 * (count[1, True] + count.get((1, False), 0))
    assert count.get((0, True), 0) <= 0.01 * count[0, False]
    means = {r.toxic: r.s for r in found.groupBy("toxic").agg(F.avg("severity").alias("s")).collect()}
    assert means[1] > means[0] + 0.5
    assert found.filter((F.col("severity") < F.col("toxic_probability")) | (F.col("severity") > 2)).count() == 0


def test_scores_match_brute_force(spark):
    """Every document, against counts of whole words and their starts by splitting the text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit_severity(docs, labels)
    size = len(model.starts)
    want = {}
    for row in docs.collect():
        text = (row.text or "").lower()
        counted, words, score = _starts(text), max(len(text.split()), 1), 0.0
        for i, start in enumerate(model.starts):
            if n := counted.get(start, 0):
                score += model.weights[i] + model.weights[size + i] * np.log1p(1000.0 * n / words) / 4
        above = [1 / (1 + np.exp(cut - score)) for cut in model.cuts]
        want[row.doc_id] = (above[0], sum(above))
    found = {r._id: (r.toxic_probability, r.severity, r.rejected) for r in score_severity(docs, model).collect()}
    assert size > 100 and found.keys() == want.keys()
    for i, (chance, severity) in want.items():
        assert np.isclose(found[i][0], chance) and np.isclose(found[i][1], severity) and found[i][2] == (found[i][0] >= 0.5)


def test_thresholds_share_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    score = x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=3000)
    grades = (score > 0.5).astype(int) + (score > 2)
    weights, cuts = _fit(x, grades)
    assert np.allclose(weights, [2, -1, 0, 0.5], atol=0.25) and np.allclose(cuts, [0.5, 2], atol=0.25)


def test_matcher_counts_what_the_words_have():
    starts = ["idio", "idiot ", "clow", "idiot"]
    text = "Idiot, idiots! CLOWN xidiot idiot"
    found, words = Matcher(starts).counts(text)
    plain = _starts(text)
    assert {starts[i]: n for i, n in found.items()} == {s: plain[s] for s in starts if plain[s]} and words == 5


def test_odd_documents(spark):
    docs = documents(spark)
    model = Model(("alph",), (5.0, 0.0), (1.0, 3.0))
    got = {r._id: r for r in score_severity(docs, model).collect()}
    assert got[1].rejected and got[3].rejected and not got[4].rejected and not got[7].rejected
    assert got[1].severity == got[2].severity and score_severity(docs, model).count() == docs.count()
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert score_severity(empty(spark), model).count() == 0 and drop_toxic(empty(spark), model).count() == 0


def test_many_documents_on_few_ids_stay_within_the_bound(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(toxicity, "_fit", lambda x, grades: rows.append(len(x)) or _fit(x, grades))
    docs = spark.range(50_000).select(
        (F.col("id") % 2).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "idiot word").otherwise("plain word"), F.lit(" x"), F.col("id") % 30_000).alias("text")
    )
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_severity(docs, labels, training=300)
    assert rows == [300] and "idio" in model.starts
    # Equal rows count once.
    few = spark.range(50_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 20).alias("text"))
    fit_severity(few, labels, training=300)
    assert rows == [300, 20]


def test_no_labels_reject_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_severity(documents(spark), labels)
    assert model.cuts == () and drop_toxic(documents(spark), model).count() == documents(spark).count()
    assert fit_severity(empty(spark), labels).cuts == ()
