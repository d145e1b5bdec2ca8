import os
from types import SimpleNamespace

import pytest

from cropline import session


def fake(folder, master="yarn"):
    used = {}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: used.get("dir"), setCheckpointDir=lambda d: used.update(dir=d)
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: folder)), used


def test_the_cluster_names_the_folder():
    spark, used = fake("hdfs:///shared")
    assert session.shared_folder(spark) == "hdfs:///shared" and used == {"dir": "hdfs:///shared"}


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(None)[0])


def test_local_mode_makes_its_own(monkeypatch, tmp_path):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    assert session.shared_folder(fake(None, "local[2]")[0]) == str(tmp_path)


def test_materialised_rows_keep_types(frame):
    df = frame("a int, b array<string>, c struct<x:double>, d timestamp_ntz", [(1, ["x"], (2.0,), None)])
    stored = session.materialise(df)
    assert stored.schema == df.schema and stored.collect() == df.collect()
    assert session.materialise(df.limit(0)).count() == 0


def test_passing_tables_are_deleted(spark):
    with session.passing_tables(spark):
        table = session.materialise(spark.range(5))
        assert table.count() == 5
        path = table.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert session.materialise(spark.range(3)).count() == 3


def test_what_derives_from_a_table_is_computed_once_and_outlives_a_batch(spark):
    source, made = session.materialise(spark.range(5)), []

    def doubled(rows):
        made.append(1)
        return rows.selectExpr("id * 2 AS id")

    with session.passing_tables(spark):
        first = session.derived(source, "doubled", doubled)
    again = session.derived(source, "doubled", doubled)
    assert made == [1] and first is again and sorted(r.id for r in again.collect()) == [0, 2, 4, 6, 8]
    other = session.derived(session.materialise(spark.range(1)), "doubled", doubled)
    assert made == [1, 1] and [r.id for r in other.collect()] == [0]
