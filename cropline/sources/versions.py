"""Parquet tables in versions, replaced partition by partition.

    data/write=<id>/<key>=<value>/part-*.parquet   files of one write, never changed after it
    versions/<number>.json                         for each partition, the write that holds it

A write goes to a folder of its own, which nobody reads. Then one small file names
the partitions of the next version, and is renamed into place if that number is not
taken. So a reader sees the old version or the new one and never both, a writer that
fails leaves the old version as it is, and of two writers the second takes the
next number, on top of what the first has committed. Readers may stay with a version.

A version file has one entry for each partition, states or years here, not one for each
file or row. The rename must fail if its target is there, as that of HDFS does; an object store
without such a rename needs a committer that has it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from cropline.functions.joins import lookup
from cropline.session import materialise

# Rows of one file at most.
FILE_ROWS = 1_000_000

# The folder of rows without a value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

Entries = dict[str, dict[str, str | int]]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    system, folder = _system(spark, path), _path(spark, f"{path}/versions")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def entries(spark: SparkSession, path: str, version: int | None = None) -> Entries:
    """Partitions of a version, the newest one if none is given: what was said about each when it was written."""
    known = versions(spark, path)
    if version is None:
        if not known:
            return {}
        version = known[-1]
    elif version not in known:
        raise ValueError(f"no version {version} of {path}")
    text = spark.read.text(f"{path}/versions/{version}.json", wholetext=True).first()[0]
    return json.loads(text)["partitions"]


def commit(spark: SparkSession, path: str, change: Callable[[Entries], Entries]) -> int:
    """Commit ``change`` of the newest version's partitions as the next version; its number."""
    jvm, system = spark._jvm, _system(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, path).toUri(), spark._jsc.hadoopConfiguration()
    )
    plainly = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        number = max(versions(spark, path), default=0)
        content = json.dumps({"partitions": change(entries(spark, path, number) if number else {})}, sort_keys=True)
        draft = _path(spark, f"{path}/versions/.{uuid.uuid4().hex}.draft")
        stream = system.create(draft, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        try:
            context.rename(draft, _path(spark, f"{path}/versions/{number + 1}.json"), plainly)
            return number + 1
        except Py4JJavaError as error:
            system.delete(draft, False)
            # Another writer was faster: its version is the base now.
            if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise


def _value(key: str) -> Column:
    """A partition's value; one without rows of its own, null or empty, is empty."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """Rows of every value of ``key``, stored; reads the key column only."""
    return materialise(df.groupBy(_value(key).alias("_value")).agg(F.count(F.lit(1)).alias("_rows")))


def sized(df: DataFrame, key: str, rows: int = FILE_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``df`` dealt to tasks by ``key``, each value to as many as its number of rows asks for.

    The rows of every value are counted first, if ``counts`` does not have them. A value with
    nearly all rows goes to nearly all tasks, and small values to one each. Rows equal in
    every column go to one task.
    """
    name = _value(key)
    parts = (counts if counts is not None else histogram(df, key)).select(
        "_value", F.ceil(F.col("_rows") / F.lit(rows)).cast("int").alias("_parts")
    )
    before = Window.orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    places = materialise(parts.withColumn("_first", F.coalesce(F.sum("_parts").over(before), F.lit(0)).cast("int")))
    tasks = places.agg(F.sum("_parts")).first()[0] or 1
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_parts"))
    dealt = lookup(df.withColumn("_named", name), places, {"_named": "_value"}, "inner")
    placed = dealt.withColumn("_task", (F.col("_first") + part).cast("int"))
    return placed.repartitionById(tasks, "_task").select(*df.columns)


def write_partitions(
    df: DataFrame,
    path: str,
    key: str,
    rows: int = FILE_ROWS,
    source: dict[str, str] | None = None,
    only: bool = False,
    without: tuple[str, ...] = (),
) -> int:
    """Replace the partitions of ``key`` that ``df`` has, in one new version; its number.

    Partitions named in ``without`` leave, and with ``only`` all that ``df`` does not have.
    ``source`` notes for partitions what they were made from. The write counts its rows; if they
    are not those that the layout was made for, nothing is committed.
    """
    spark, write = df.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/write={write}"
    counts = histogram(df, key)
    known = {row["_value"]: row["_rows"] for row in counts.collect()}
    written = Observation()
    observed = sized(df, key, rows, counts).observe(written, F.count(F.lit(1)).alias("rows"))
    observed.write.option("maxRecordsPerFile", rows).partitionBy(key).parquet(folder)
    if known and written.get["rows"] != sum(known.values()):
        raise ValueError(f"{written.get['rows']} rows were written instead of {sum(known.values())}")
    new = {}
    for status in _system(spark, path).listStatus(_path(spark, folder)):
        if status.isDirectory():
            name = status.getPath().getName()
            value = unquote(name.removeprefix(f"{key}=")).replace(_NO_VALUE, "")
            new[name] = {"write": write, "rows": known[value]} | ({"source": source[name]} if source else {})

    def change(old: Entries) -> Entries:
        kept = {} if only else {n: e for n, e in old.items() if n not in without}
        return {**kept, **new}

    return commit(spark, path, change)


def version_rows(spark: SparkSession, path: str, version: int | None = None) -> int:
    """Rows of a version, as counted when its partitions were written: no file is read."""
    return sum(e["rows"] for e in entries(spark, path, version).values())


def read_partitions(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: T.StructField,
    version: int | None = None,
    partitions: list[str] | None = None,
) -> DataFrame:
    """Rows of a version, the newest one if none is given, of all or the named partitions.

    The columns are those of ``schema`` and ``key``; a filter on ``key`` prunes files.
    """
    held = entries(spark, path, version)
    names = held if partitions is None else [n for n in partitions if n in held]
    folders = [f"{path}/data/write={held[n]['write']}/{n}" for n in sorted(names)]
    layout = T.StructType([*schema, key])
    if not folders:
        return spark.createDataFrame([], layout)
    whole = T.StructType([*layout, T.StructField("write", T.StringType())])
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders).select(*layout.names)


def forget_versions(spark: SparkSession, path: str, keep: int = 2, min_age_hours: float = 24.0) -> list[str]:
    """Delete all but the ``keep`` newest versions, and writes that these do not refer to.

    Writes younger than ``min_age_hours`` stay, as a writer may be about to commit
    them. Returns the names of the deleted writes.
    """
    system, known = _system(spark, path), versions(spark, path)
    used = {e["write"] for n in known[-keep:] for e in entries(spark, path, n).values()}
    for number in known[:-keep]:
        system.delete(_path(spark, f"{path}/versions/{number}.json"), False)
    newest = spark._jvm.java.lang.System.currentTimeMillis() - min_age_hours * 3_600_000
    gone = []
    for status in system.listStatus(_path(spark, f"{path}/data")):
        write = status.getPath().getName().removeprefix("write=")
        if write not in used and status.getModificationTime() < newest:
            system.delete(status.getPath(), True)
            gone.append(write)
    return sorted(gone)
