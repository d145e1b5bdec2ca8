"""Reading and writing the files the analytics work on."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cropline import schemas
from cropline.functions.constants import MISSING_TOKENS
from cropline.functions.scalars import parse_double, parse_int, strip, upper_key
from cropline.operators.clean import only_state
from cropline.sources.versions import FILE_ROWS, read_partitions, write_partitions

Paths = str | list[str]


def _read_text_columns(spark: SparkSession, path: Paths) -> DataFrame:
    """All columns of headed CSV files as text, by the names in the header.

    Only the header of the first file is looked at up front; the header of every
    other file is checked against it when the file is read.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST")
    names = reader.csv(path).columns
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.option("enforceSchema", False).schema(layout).csv(path)


def _present(c: Column) -> Column:
    return F.when(~c.isin(MISSING_TOKENS), c)


def _typed(df: DataFrame, schema: T.StructType, missing_tokens: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` that ``df`` has, by name and with their types."""
    parsers = {T.DoubleType(): parse_double, T.IntegerType(): parse_int}
    out = []
    for field in schema.fields:
        if field.name in df.columns:
            value = _present(F.col(field.name)) if missing_tokens else F.col(field.name)
            parse = parsers.get(field.dataType)
            out.append((parse(value) if parse else value).alias(field.name))
    return df.select(*out, *extra)


def read_agri(spark: SparkSession, path: Paths, raw: bool = False) -> DataFrame:
    """Fact table. ``raw`` keeps every column as text, for ``parse_agri``; a
    missing column is an error either way."""
    text = _read_text_columns(spark, path).select(*schemas.AGRI.names)
    return text if raw else _typed(text, schemas.AGRI, missing_tokens=True)


def _by_header(spark: SparkSession, path: Paths) -> list[list[str]]:
    """Files grouped by equal headers, found in one distributed pass.

    The first line of a file is the first that the task with its first block reads. The
    number of jobs does not depend on the number of files.
    """
    try:
        files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
        lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    heads = lines.filter((F.col("file_block_start") == 0) & (strip("value") != ""))
    heads = heads.groupBy(F.col("file_path").alias("_file")).agg(F.first("value").alias("header"))
    named = files.join(heads, F.col("file") == F.col("_file"))
    groups = named.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return sorted(row.paths for row in groups.collect())


def read_prices(spark: SparkSession, path: Paths, columns: list[str] | None = None) -> DataFrame:
    """Yearly price files as one table; ``Year`` is the number the file name starts with.

    Columns are found by name: files may order them differently, have further ones
    or lack some, which are null then. Without any file the table is empty.
    """
    year = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.", 1).try_cast("int")
    tables = [empty_prices(spark)]
    for files in _by_header(spark, path):
        text = _read_text_columns(spark, files)
        found = [f for f in schemas.PRICES.names if f in text.columns]
        tables.append(_typed(text.select(*found, year.alias("Year")), schemas.PRICES, True, ("Year",)))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return df.select(*columns) if columns else df


def empty_prices(spark: SparkSession) -> DataFrame:
    """Typed price table without rows."""
    return spark.createDataFrame([], T.StructType([*schemas.PRICES, T.StructField("Year", T.IntegerType())]))


def read_rainfall(spark: SparkSession, path: Paths, subdivision: str | None = None) -> DataFrame:
    """Monthly and seasonal rainfall by subdivision and year."""
    df = _typed(_read_text_columns(spark, path), schemas.RAINFALL, missing_tokens=True)
    return df.filter(upper_key("SUBDIVISION") == subdivision) if subdivision else df


def read_production(spark: SparkSession, path: Paths, state: str | None = None) -> DataFrame:
    """Crop production, of one state if given."""
    df = _typed(_read_text_columns(spark, path), schemas.PRODUCTION, missing_tokens=True)
    return only_state(df, state, "State_Name") if state else df


COLUMN_PATTERNS = {
    "state": "state",
    "district": "district",
    "commodity": "commodity|crop",
    "min": "min",
    "max": "max",
    "modal": "modal",
}


def discover_columns(df: DataFrame, patterns: dict[str, str] = COLUMN_PATTERNS) -> dict[str, list[str]]:
    """Columns whose name matches each pattern, ignoring case, in table order.

    The first hit is the one to use as key. Looks at the schema only.
    """
    return {
        role: [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
        for role, pattern in patterns.items()
    }


def publish_agri(df: DataFrame, root: str, version: str, file_format: str = "csv") -> str:
    """Write the fact table as a new version and return its path.

    The table usually derives from an earlier version, so it never overwrites
    the files it is read from. For large tables see :func:`publish_states`.
    """
    path = f"{root}/version={version}"
    writer = df.select(*schemas.AGRI.names).write.mode("overwrite")
    if file_format == "csv":
        # Blanks around a text belong to it.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("emptyValue", "").csv(path)
    else:
        writer.format(file_format).save(path)
    return path


STATE_KEY = "state_key"


def publish_states(df: DataFrame, path: str, rows: int = FILE_ROWS) -> str:
    """Write facts as Parquet by state, in a new version that replaces the states in
    ``df`` and no others.

    The folder of a state is its upper-cased name; rows without a state have one
    of their own. Readers see the whole new version or the one before, so ``df`` may
    be read from the table itself. A state gets as many files as its rows ask for.
    """
    write_partitions(df.select(*schemas.AGRI.names, F.upper("State").alias(STATE_KEY)), path, STATE_KEY, rows)
    return path


def read_states(
    spark: SparkSession, path: str, version: int | None = None, partitions: list[str] | None = None
) -> DataFrame:
    """Facts published by state, of the newest version or a given one; a filter on
    ``state_key`` prunes files, ``partitions`` reads the named ones only."""
    key = T.StructField(STATE_KEY, T.StringType())
    return read_partitions(spark, path, schemas.AGRI, key, version, partitions)


def publish_prices(df: DataFrame, path: str, rows: int = FILE_ROWS) -> str:
    """Write prices as Parquet by year, in a new version that replaces the whole table. A
    year gets as many files as its rows ask for. Missing columns are null."""
    layout = empty_prices(df.sparkSession)
    known = df.select(*[c for c in layout.columns if c in df.columns])
    write_partitions(layout.unionByName(known, allowMissingColumns=True), path, "Year", rows, only=True)
    return path


def read_published_prices(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Prices published by year; a filter on ``Year`` prunes files."""
    return read_partitions(spark, path, schemas.PRICES, T.StructField("Year", T.IntegerType()), version)


def _log_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def prediction_rows(df: DataFrame) -> DataFrame:
    """Log rows of predictions: id, UTC time and the 12 logged columns."""
    return _log_rows(df, schemas.PREDICTION_LOG)


def auth_rows(df: DataFrame) -> DataFrame:
    """Log rows of access events; an unknown action is an error."""
    known = F.col("action").isin(*schemas.AUTH_ACTIONS)
    problem = F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))
    if "ip_address" not in df.columns:
        df = df.withColumn("ip_address", F.lit(None).cast("string"))
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("action")).otherwise(problem.cast("string"))
    return _log_rows(df.withColumn("action", checked), schemas.AUTH_EVENTS)


def write_log(rows: DataFrame, path: str, writer: str, batch: str) -> None:
    """Write one batch of log rows: the layout of all log writers.

    Each batch has a folder of its own, by day inside. Writing it again replaces
    it, and no writer touches what another one has written.
    """
    dated = rows.withColumn("date", F.to_date("timestamp"))
    dated.write.mode("overwrite").partitionBy("date").parquet(f"{path}/writer={writer}/batch={batch}")


def read_log(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTION_LOG) -> DataFrame:
    """All rows of a log, whoever wrote them, with their ``date``; a filter on it
    prunes files."""
    layout = T.StructType([*schema, T.StructField("date", T.DateType())])
    return spark.read.schema(layout).parquet(path).select(*layout.names)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append predictions, failed ones too. Ids come from the caller, because
    parallel writers have no common counter."""
    write_log(prediction_rows(df), path, "append", uuid.uuid4().hex)


def append_auth_events(df: DataFrame, path: str) -> None:
    write_log(auth_rows(df), path, "append", uuid.uuid4().hex)
