from pyspark.sql import functions as F

from cropline import schemas
from cropline.operators.aggregates import category_values
from cropline.plans.artefacts import PRICE_VOCABULARY, TABLES, derive_artefacts, fit_vocabulary
from cropline.plans.incremental import refresh_artefacts, stale_partitions
from cropline.plans.views import view
from cropline.sources import files as S
from cropline.sources.versions import entries, write_partitions

SF = "/root/testdata/sf0.001"


def same(left, right):
    return left.schema.names == right.schema.names and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def check(found, spark, facts, prices, version=None):
    agri = S.read_states(spark, facts, version).drop(S.STATE_KEY)
    want = derive_artefacts(agri, fit_vocabulary(agri, prices))
    for name in TABLES:
        assert same(getattr(found, name), getattr(want, name)), name


def test_equal_to_a_full_build_after_every_change(spark, tmp_path):
    agri, prices = view(spark, SF, "agri"), view(spark, SF, "price_facts")
    facts, root = str(tmp_path / "facts"), str(tmp_path / "artefacts")
    odd = agri.limit(3).withColumns({"State": F.lit(None).cast("string"), "Crop": F.lit("only here")})
    mixed = agri.filter("State = 'ASIA'").limit(5).withColumn("State", F.lit("Asia"))
    S.publish_states(agri.unionByName(odd).unionByName(mixed), facts)
    values = category_values(prices, PRICE_VOCABULARY, "price")
    check(refresh_artefacts(spark, facts, root, values), spark, facts, prices)
    first = entries(spark, f"{root}/sums")

    # One state gets other rows, one that was not there comes.
    some = agri.filter("State = 'EUROPE' AND Year % 2 = 0").unionByName(agri.limit(2).withColumn("State", F.lit("NEW")))
    S.publish_states(some, facts)
    stale, gone = stale_partitions(spark, facts, f"{root}/sums")
    assert (stale, gone) == (["state_key=EUROPE", "state_key=NEW"], [])
    read = S.read_states(spark, facts, partitions=stale)
    assert all("state_key=EUROPE" in f or "state_key=NEW" in f for f in read.inputFiles())
    check(refresh_artefacts(spark, facts, root, values), spark, facts, prices)
    second = entries(spark, f"{root}/sums")
    assert {n for n in second if second[n] != first.get(n)} == set(stale)

    # A state leaves; its categories leave with it.
    write_partitions(agri.limit(0).select(*schemas.AGRI.names, F.upper("State").alias(S.STATE_KEY)), facts, S.STATE_KEY, without=("state_key=__HIVE_DEFAULT_PARTITION__",))
    found = refresh_artefacts(spark, facts, root, values)
    check(found, spark, facts, prices)
    assert found.vocab.filter("value = 'only here'").isEmpty()
    # Nothing to do: no new partials.
    before = entries(spark, f"{root}/values")
    refresh_artefacts(spark, facts, root, values)
    assert entries(spark, f"{root}/values") == before and stale_partitions(spark, facts, f"{root}/sums") == ([], [])
    # An older version of the facts can be asked for again.
    check(refresh_artefacts(spark, facts, root, values, version=1), spark, facts, prices, 1)
