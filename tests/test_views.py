import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from cropline.operators import scoring as M
from cropline.plans import driver_queries as Q, views as V

FOLDER = "/root/testdata/sf0.001"
OVER_BASE = [name for name in V.VIEWS if "base" in V.needed([name])]


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with rows twice and keys that are null or have no match."""
    tmp_path = tmp_path_factory.mktemp("tables")
    for table in V.TABLES:
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        rows = rows.limit(800) if table in ("lineitem", "orders") else rows
        key = rows.columns[0]
        odd = rows.limit(3).withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
        rows.unionByName(rows.limit(2)).unionByName(odd).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", OVER_BASE + ["full_requests", "rainfall"])
def test_stored_view_has_the_rows_of_the_view(spark, folder, name):
    assert same(V.stored_view(spark, folder, name), V.view(spark, folder, name))


def test_base_is_joined_once(spark, folder):
    kept = [set(V.stored_view(spark, folder, name).inputFiles()) for name in ("agri", "prices", "production")]
    assert kept[0] == kept[1] == kept[2]
    assert not any("lineitem" in file or "orders" in file for file in kept[0])


def test_changed_tables_are_joined_again(spark, folder):
    # The last test that uses the folder.
    before = V.stored_view(spark, folder, "agri_all").count()
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").limit(10).localCheckpoint()
    rows.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    after = V.stored_view(spark, folder, "agri_all")
    assert after.count() < before and same(after, V.view(spark, folder, "agri_all"))


@pytest.mark.parametrize("name", ["base", "full_requests"])
def test_part_is_not_broadcast(spark, name):
    plan = V._merged_view(spark, FOLDER, name, V.VIEWS)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "p_partkey" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


ONCE = ["rejected_requests", "saved_models", "score_direct_fixed", "predict_contract", "refresh_artefacts", "publish_states"]


@pytest.mark.parametrize("name", ONCE)
def test_query_joins_the_tables_once(spark, name, monkeypatch):
    """All views over ``base`` that a query reads come from stored rows."""
    asked = []
    monkeypatch.setattr(Q, "view", lambda spark, sf, name: asked.append(name) or V.view(spark, sf, name))
    if name == ONCE[0]:
        Q._built.cache_clear()
    entry.queries()[name](spark, FOLDER)
    assert not set(asked) & set(OVER_BASE)


def test_rows_are_encoded_once_to_fit_and_score(spark, monkeypatch):
    encoded = []
    for kind in ("yield_training_rows", "price_training_rows"):
        make = getattr(M, kind)
        monkeypatch.setattr(M, kind, lambda *a, make=make, kind=kind: encoded.append(kind) or make(*a))
    Q.fit_models(spark, FOLDER)
    assert sorted(encoded) == ["price_training_rows", "yield_training_rows"]


def test_fit_models_grows_all_trees(spark, monkeypatch):
    fitted = []
    for kind in ("fit_yield", "fit_price"):
        fit = getattr(M, kind)
        monkeypatch.setattr(M, kind, lambda *a, fit=fit, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    Q.fit_models(spark, FOLDER)
    assert [len(m.trees) for m in fitted] == [20, 20] and max(t.depth for m in fitted for t in m.trees) == 5


def test_fit_on_stored_rows_is_that_on_the_facts(spark):
    facts, vocab = V.view(spark, FOLDER, "price_facts"), Q._artefacts(spark, FOLDER).price_vocab
    rows = Q._price_rows(spark, FOLDER, "market")
    models = [M.fit_price(facts, vocab, **Q.TREES), M.fit_price(rows, None, **Q.TREES)]
    found = [M.score_price(rows, m).agg(F.sum("predicted_price")).first()[0] for m in models]
    assert found[0] == pytest.approx(found[1], rel=1e-6)
