"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cropline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    A temporary folder stands in for it only in local mode, where driver and
    executors are one process; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cropline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that :func:`materialise` stores inside, at the end.

    For work that ends with an action, such as a micro-batch. A DataFrame that is
    returned and read later needs its tables.
    """
    token = _tables.set([])
    try:
        yield
    finally:
        paths = _tables.get() or []
        _tables.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_derived: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()


def derived(source: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(source)``, computed once for a table and stored as long as the table is in use.

    For what every batch of requests would otherwise compute again from the same lookup
    table. ``source`` must not change: it is a stored version, read once. What derives from
    it outlives the micro-batch that asks for it first.
    """
    known = _derived.setdefault(source, {})
    if name not in known:
        token = _tables.set(None)
        try:
            known[name] = materialise(make(source))
        finally:
            _tables.reset(token)
    return known[name]


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from a table in the shared folder.

    Used for tables that several joins of one query read, so that their lineage
    is neither planned nor run more than once and a lost executor does not
    restart it. As Parquet the table can be pruned, and its size is known to the
    planner. Outside of :func:`passing_tables` the folder is not emptied: give it
    a retention.
    """
    path = f"{shared_folder(df.sparkSession)}/cropline/{uuid.uuid4().hex}"
    stored = _tables.get()
    if stored is not None:
        stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
