import os
import threading

import pytest
from pyspark.sql import functions as F, types as T

from cropline.sources import versions as V

SCHEMA = T.StructType([T.StructField("v", T.LongType())])
KEY = T.StructField("k", T.StringType())


def rows_of(spark, path, version=None):
    return sorted((r.k or "", r.v) for r in V.read_partitions(spark, path, SCHEMA, KEY, version).collect())


def table(frame, *rows):
    return frame("v long, k string", list(rows))


def test_readers_keep_the_version_they_read(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert V.write_partitions(table(frame, (1, "a"), (2, "b"), (3, None)), path, "k") == 1
    pinned = V.read_partitions(spark, path, SCHEMA, KEY)
    assert V.write_partitions(table(frame, (9, "a"), (8, "c")), path, "k") == 2
    assert rows_of(spark, path, 1) == [("", 3), ("a", 1), ("b", 2)] == sorted((r.k or "", r.v) for r in pinned.collect())
    assert rows_of(spark, path) == [("", 3), ("a", 9), ("b", 2), ("c", 8)]
    with pytest.raises(ValueError, match="no version 7"):
        V.entries(spark, path, 7)


def test_a_table_can_be_rewritten_from_itself(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    V.write_partitions(table(frame, (1, "a"), (2, "a"), (3, "b")), path, "k")
    V.write_partitions(V.read_partitions(spark, path, SCHEMA, KEY).filter("v <> 1"), path, "k")
    assert rows_of(spark, path) == [("a", 2), ("b", 3)]


def test_a_failed_writer_leaves_the_old_version(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.write_partitions(table(frame, (1, "a"), (2, "b")), path, "k")
    # Some tasks write their files, one fails.
    failing = spark.range(200).select(
        F.when(F.col("id") == 150, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("id")).alias("v"),
        F.when(F.col("id") < 100, "a").otherwise("z").alias("k"),
    )
    with pytest.raises(Exception, match="midway"):
        V.write_partitions(failing, path, "k", rows=10)
    assert rows_of(spark, path) == [("a", 1), ("b", 2)] and V.versions(spark, path) == [1]
    # All files are written, the commit fails.
    monkeypatch.setattr(V, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        V.write_partitions(table(frame, (5, "a")), path, "k")
    monkeypatch.undo()
    assert rows_of(spark, path) == [("a", 1), ("b", 2)]
    assert len(list((tmp_path / "t" / "data").iterdir())) >= 2
    assert V.forget_versions(spark, path, min_age_hours=24) == []
    assert len(V.forget_versions(spark, path, min_age_hours=-1)) >= 1
    assert rows_of(spark, path) == [("a", 1), ("b", 2)]


def test_writers_at_the_same_time_lose_nothing(spark, frame, tmp_path):
    path, numbers = str(tmp_path / "t"), []
    V.write_partitions(table(frame, (0, "a")), path, "k")
    # Both commits start from version 1.
    gate, real = threading.Barrier(2, timeout=60), V.entries
    seen = []

    def entries(spark_, path_, version=None):
        found = real(spark_, path_, version)
        if version == 1 and len(seen) < 2:
            seen.append(1)
            gate.wait()
        return found

    V.entries = entries
    try:
        jobs = [
            threading.Thread(target=lambda k=k: numbers.append(V.write_partitions(table(frame, (7, k)), path, "k"))) for k in ("b", "c")
        ]
        for job in jobs:
            job.start()
        for job in jobs:
            job.join(120)
    finally:
        V.entries = real
    assert sorted(numbers) == [2, 3] and rows_of(spark, path) == [("a", 0), ("b", 7), ("c", 7)]


def test_files_follow_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).select(F.col("id").alias("v"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("k"))
    V.write_partitions(rows, path, "k", rows=1000)
    read = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    files = read.groupBy("k", F.col("_metadata.file_path").alias("file")).count().collect()
    sizes = {k: sorted(r["count"] for r in files if r.k == k) for k in {r.k for r in files}}
    assert len(sizes["hot"]) >= 9 and max(map(max, sizes.values())) <= 1000
    assert all(len(sizes[k]) == 1 for k in sizes if k != "hot")
    # One task for each part of the hot value.
    tasks = V.sized(rows, "k", 1000).groupBy(F.spark_partition_id().alias("p"), "k").count()
    assert tasks.filter("k = 'hot'").count() == 9
    assert V.read_partitions(spark, path, SCHEMA, KEY).count() == 10_000


def test_rows_equal_in_every_column_make_bounded_files(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_partitions(spark.range(500).select(F.lit(1).cast("long").alias("v"), F.lit("a").alias("k")), path, "k", rows=100)
    assert len(list((tmp_path / "t" / "data").rglob("part-*.parquet"))) == 5
    assert V.read_partitions(spark, path, SCHEMA, KEY).count() == 500


def test_rows_are_counted_by_the_write(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    V.write_partitions(table(frame, (1, "a"), (2, "a"), (3, None), (4, ""), (5, "b/ c=%")), path, "k")
    V.write_partitions(table(frame, (1, "a")), path, "k")
    assert [V.version_rows(spark, path, n) for n in (1, 2)] == [5, 4] and V.version_rows(spark, path) == 4
    # Rows that change between two readings are not committed.
    flip = F.udf(lambda _: os.urandom(1)[0] < 128, "boolean").asNondeterministic()
    changing = spark.range(1000).filter(flip("id")).select(F.col("id").alias("v"), F.lit("a").alias("k"))
    with pytest.raises(ValueError, match="rows were written instead of"):
        for _ in range(5):
            V.write_partitions(changing, path, "k")


def test_partitions_leave_and_empty_tables(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert V.versions(spark, path) == [] and rows_of(spark, path) == []
    V.write_partitions(table(frame), path, "k")
    assert rows_of(spark, path) == [] and V.versions(spark, path) == [1]
    V.write_partitions(table(frame, (1, "a"), (2, "b/ c=%")), path, "k")
    assert rows_of(spark, path) == [("a", 1), ("b/ c=%", 2)]
    V.write_partitions(table(frame, (3, "c")), path, "k", without=("k=a",))
    assert rows_of(spark, path) == [("b/ c=%", 2), ("c", 3)]
    V.write_partitions(table(frame, (4, "d")), path, "k", only=True)
    assert rows_of(spark, path) == [("d", 4)]
